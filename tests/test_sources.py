import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stayline.operators.summaries import latest_subscription
from stayline.plans.master import build_master
from stayline.plans.reports import all_reports
from stayline.schemas import SUPPORT_TICKETS, TABLES
from stayline.sources import sinks
from stayline.sources.star_schema import business_tables
from stayline.sources.tables import (
    MissingInput,
    load_tables,
    preview,
    read_catalog_table,
    read_csv_table,
    read_parquet_table,
    register_views,
    table_profile,
)


def test_csv_is_read_by_name_and_leniently(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "priority,ticket_id,account_id,satisfaction_score,escalation_flag,resolution_time_hours,submitted_at,extra\n"
        "urgent,t1,a,4.0,True,2.5,2024-01-02 03:04:05,x\n"
        "NA,t2,a,,False,bad,,\n"
        "low,t3,a,nan,,NaN,2024-01-02,y\n"
    )
    df = read_csv_table(spark, str(path), SUPPORT_TICKETS)
    assert dict(df.dtypes)["satisfaction_score"] == "double" and dict(df.dtypes)["extra"] == "string"
    a, b, c = df.orderBy("ticket_id").collect()
    assert (a.priority, a.satisfaction_score, a.escalation_flag, a.resolution_time_hours) == ("urgent", 4, True, 2.5)
    assert a.submitted_at == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert (b.priority, b.satisfaction_score, b.escalation_flag, b.resolution_time_hours) == (None, None, False, None)
    assert (c.satisfaction_score, c.escalation_flag, c.resolution_time_hours) == (None, None, None)


def test_fractions_and_times_of_day_are_not_cut_off(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "subscription_id,account_id,start_date,plan_tier,seats\n"
        "s1,a,2024-01-02 08:00:00,Basic,4.0\ns2,a,2024-01-02 09:00:00,Pro,4.5\ns3,,2024-01-03,Pro,1\ns4,b,2024-01-03,Basic,x\n"
    )
    df = read_csv_table(spark, str(tmp_path / "s.csv"), TABLES["subscriptions"])
    assert {r.subscription_id: r.seats for r in df.collect()} == {"s1": 4, "s2": None, "s3": 1, "s4": None}
    assert {r.account_id: r.sub_plan_tier for r in latest_subscription(df).collect()} == {"a": "Pro", "b": "Basic"}
    (tmp_path / "t.csv").write_text("ticket_id,account_id,satisfaction_score\nt1,a,4.5\nt2,a,4\n")
    tickets = read_csv_table(spark, str(tmp_path / "t.csv"), SUPPORT_TICKETS)
    assert sorted(r.satisfaction_score for r in tickets.collect()) == [4.0, 4.5]


def test_csv_files_are_split(spark, tmp_path):
    for name, schema in TABLES.items():
        (tmp_path / f"{name}.csv").write_text(",".join(schema.fieldNames()) + "\n" + f"{name},x\n" * 20_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        tables = load_tables(spark, str(tmp_path))
        assert all(df.rdd.getNumPartitions() > 1 for df in tables.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_line_breaks_in_feedback(spark, tmp_path):
    for name, schema in TABLES.items():
        (tmp_path / f"x_{name}.csv").write_text(",".join(schema.fieldNames()) + "\n")
    with open(tmp_path / "x_churn_events.csv", "a") as f:
        f.write('e1,a,2024-03-01,pricing,12.50,False,False,True,"too ""dear"",\nsorry"\n')
    tables = load_tables(spark, str(tmp_path), prefix="x_")
    (row,) = tables["churn_events"].collect()
    assert row.feedback_text == 'too "dear",\nsorry'
    assert row.refund_amount_usd == Decimal("12.50") and row.churn_date == datetime.date(2024, 3, 1)
    profile = {r.table_name: (r.n_rows, r.n_cols) for r in table_profile(tables).collect()}
    assert profile["churn_events"] == (1, 9) and profile["accounts"] == (0, 10)


@pytest.mark.parametrize("read", [
    lambda s, p: read_csv_table(s, p, SUPPORT_TICKETS), read_parquet_table, lambda s, p: read_catalog_table(s, "no_such"),
])
def test_missing_input_is_named(spark, tmp_path, read):
    with pytest.raises(MissingInput, match="no_such"):
        read(spark, str(tmp_path / "no_such"))


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="orc"):
        load_tables(spark, "x", "orc")


def test_parquet_and_catalog_round_trip(spark, folder, tmp_path):
    tables = business_tables(spark, folder)
    spark.sql("CREATE DATABASE shop")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        df.write.saveAsTable(f"shop.{name}")
    for again in (load_tables(spark, str(tmp_path), "parquet"), load_tables(spark, "shop", "catalog")):
        assert {n: d.count() for n, d in again.items()} == {n: d.count() for n, d in tables.items()}


def test_reports_also_run_as_sql_over_views(spark, folder):
    tables = business_tables(spark, folder)
    register_views(tables, "v_")
    sql = spark.sql("SELECT plan_tier, count(*) n FROM v_accounts GROUP BY plan_tier ORDER BY plan_tier").collect()
    df = all_reports(tables)["churn_by_plan"].orderBy("plan_tier").collect()
    assert [r.n for r in sql] == [r.total_customers for r in df]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "P1 — x"), ("b", "P4 — y")], "account_name string, retention_priority string")
    sinks.write_scored(df, f"{tmp_path}/scored")
    again = spark.read.parquet(sinks.current(spark, f"{tmp_path}/scored")).filter("priority_class = 'P4'")
    assert [r.account_name for r in again.collect()] == ["b"]
    sinks.write_actions(df, f"{tmp_path}/actions")
    (part,) = (tmp_path / "actions").glob("v*/part-*")
    assert part.read_text(encoding="utf-8").splitlines()[0] == "account_name,retention_priority"
    for fmt in ("parquet", "csv"):
        sinks.write_master(df, f"{tmp_path}/m_{fmt}", fmt)
        sinks.write_master(df, f"{tmp_path}/m_{fmt}", fmt)
        assert spark.read.option("header", True).format(fmt).load(sinks.current(spark, f"{tmp_path}/m_{fmt}")).count() == 2
    assert preview(df, 1).count() == 1


def test_a_failing_write_leaves_the_earlier_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    good = spark.range(10)
    sinks.write_small(good, path)
    # fails in the last of several tasks, when others have written their files
    broken = spark.range(0, 1000, 1, 4).withColumn("x", F.when(F.col("id") == 999, F.raise_error("lost")).otherwise(F.lit("1")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_small(broken, path)
    assert read_parquet_table(spark, path).count() == 10
    sinks.write_small(spark.range(20), path)
    assert read_parquet_table(spark, path).count() == 20


def test_readers_and_versions(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_small(spark.range(1), path)
    begun = read_parquet_table(spark, path)
    for n in range(2, 5):
        sinks.write_small(spark.range(n), path)
        # one more write does not take the files from a reader that has begun
        assert begun.count() == n - 1
        begun = read_parquet_table(spark, path)
    assert len(list((tmp_path / "t").glob("v*"))) == 2
    plain = f"{tmp_path}/plain"
    spark.range(3).write.parquet(plain)
    assert sinks.current(spark, plain) == plain and read_parquet_table(spark, plain).count() == 3


def test_bucketed_tables_join_without_exchange(spark, folder):
    tables = business_tables(spark, folder)
    spark.sql("CREATE DATABASE bucketed")
    sinks.write_bucketed(tables, "bucketed", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        as_of = datetime.date(1997, 1, 1)
        master = build_master(load_tables(spark, "bucketed", "catalog"), as_of)
        plan = master._jdf.queryExecution().executedPlan().toString()
        moved = sorted(re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan))
        # usage alone moves, and the pairs of subscription and account that it is joined to
        assert moved[:2] == ["account_id", "account_id, feature_name"] and all(keys.startswith("subscription_id") for keys in moved[2:])
        assert plan.count("SortMergeJoin") >= 4
        plain = build_master(tables, as_of)
        assert len(re.findall(r"Exchange hashpartitioning\(account_id#", plain._jdf.queryExecution().executedPlan().toString())) > 3
        assert master.exceptAll(plain.select(master.columns)).count() == 0 and master.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
