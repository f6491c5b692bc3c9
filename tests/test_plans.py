"""Plan shapes that matter at scale."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stayline.operators.segments import value_segment
from stayline.plans.kpis import kpis
from stayline.plans.master import build_master
from stayline.session import durable, shared_folder
from stayline.sources.star_schema import business_tables

QUERIES = __spark_entry__.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "master_table", "kpis", "usage_summary", "report_revenue_at_risk", "report_top_customers", "mrr_histogram",
    "value_segment", "retention_actions", "box_errors", "roc_auc", "stratified_split_sizes", "impute_median",
])
def test_no_cross_join_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert not re.search("NestedLoop|Cartesian|Python|ArrowEval", text)


def test_kpis_read_neither_usage_nor_churn_events(spark, folder):
    text = plan(kpis(build_master(business_tables(spark, folder))))
    assert "l_orderkey" not in text and "'signup'" not in text and text.count("FileScan") == 4


def test_reports_read_only_their_columns(spark, folder):
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["report_feature_errors"](spark, folder)))
    assert scans == ["l_partkey:bigint,l_quantity:double,l_discount:double"]
    text = plan(QUERIES["report_churn_reasons"](spark, folder))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in text


def test_usage_is_reduced_before_its_first_exchange_and_before_the_join(spark, folder):
    lines = plan(QUERIES["usage_summary"](spark, folder)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "l_linenumber" in line and "FileScan" in line)
    above = [line for line in lines[:scan] if re.search("Exchange hash|HashAggregate|Join", line)][::-1]
    kinds = ["join" if "Join" in line else "exchange" if "Exchange" in line else "aggregate" for line in above]
    assert kinds[:4] == ["aggregate", "exchange", "aggregate", "join"]


def test_a_hot_account_leaves_one_partial_row_per_task(spark, folder):
    """A third of the subscriptions belong to one account; the exchange still carries little."""
    subs = spark.range(0, 30000, numPartitions=4).select(
        F.col("id").alias("subscription_id"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5).alias("account_id"),
        F.lit(None).cast("date").alias("start_date"),
        F.col("id").alias("mrr_amount"),
    )
    from stayline.operators.summaries import latest_subscription

    df = latest_subscription(subs)
    assert {r.account_id: r.mrr_amount for r in df.collect()} == {-1: 0, 0: 5, 1: 1, 2: 2, 3: 8, 4: 4}
    text = plan(df)
    assert text.index("partial_min") > text.index("Exchange hashpartitioning(account_id")


def test_top_lists_do_not_sort_everything(spark, folder):
    assert "TakeOrderedAndProject" in plan(QUERIES["retention_actions"](spark, folder))
    assert "TakeOrderedAndProject" in plan(QUERIES["report_top_customers"](spark, folder))


def test_value_segment_moves_no_account_row(spark, folder):
    """The wide rows meet the two boundary accounts as a scalar, with no exchange of their own."""
    accounts = durable(spark.range(50).select(F.col("id").alias("account_id"), F.col("id").alias("mrr_amount")), "t")
    text = plan(value_segment(accounts)).split("Subquery")[0]
    assert "Exchange" not in text


class FakeSession:
    def __init__(self, master, folder=None):
        settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/w"}
        self.conf = SimpleNamespace(get=lambda key, default=None: settings.get(key) or default)
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_shared_folder():
    assert shared_folder(FakeSession("yarn", "hdfs://x/ck")) == "hdfs://x/ck"
    assert shared_folder(FakeSession("local[2]")) == "file:/w/_work"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn"))


def test_entry(spark):
    actions = __spark_entry__.entry(spark)
    assert actions.count() == 20
    assert actions.columns[-1] == "recommended_action"
