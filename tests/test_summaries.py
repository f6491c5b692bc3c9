import datetime
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stayline.operators import summaries as U
from stayline.plans.kpis import churn_rate_by, churn_reason_counts, kpi_text, kpis
from stayline.plans.master import build_master
from stayline.sources.star_schema import business_tables

D = datetime.date


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_latest_subscription_breaks_ties_by_id_and_keeps_undated(spark):
    df = spark.createDataFrame(
        [
            ("a", "s1", D(2024, 1, 1), "Basic"), ("a", "s3", D(2024, 5, 1), "Pro"), ("a", "s2", D(2024, 5, 1), "Enterprise"),
            ("a", "s0", None, "Basic"), ("b", "s5", None, "Pro"), ("b", "s4", None, "Basic"),
        ],
        "account_id string, subscription_id string, start_date date, plan_tier string",
    )
    assert rows(U.latest_subscription(df), "account_id") == [("a", "Enterprise"), ("b", "Basic")]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "string"])
def test_latest_subscription_sees_the_time_of_day(spark, kind):
    df = spark.createDataFrame(
        [("a", "s1", "2024-05-01 08:00:00", "Basic"), ("a", "s2", "2024-05-01 09:00:00", "Pro")],
        "account_id string, subscription_id string, start_date string, plan_tier string",
    ).withColumn("start_date", F.col("start_date").cast(kind))
    assert rows(U.latest_subscription(df), "account_id") == [("a", "Pro")]


def test_support_summary_nulls(spark):
    df = spark.createDataFrame(
        [
            ("a", "t1", 2.0, 10, None, "urgent", True), ("a", "t2", 4.0, None, None, None, None),
            ("b", "t3", None, 5, 4, "low", False), (None, "t4", 9.0, 9, 1, "urgent", True),
        ],
        "account_id string, ticket_id string, resolution_time_hours double, first_response_time_minutes int, "
        "satisfaction_score int, priority string, escalation_flag boolean",
    )
    assert rows(U.support_summary(df), "account_id") == [
        ("a", 2, 3.0, 10.0, None, 1, 1), ("b", 1, None, 5.0, 4.0, 0, 0),
    ]


def test_churn_summary_first_stated_reason_and_empty_refund(spark):
    df = spark.createDataFrame(
        [
            ("a", "e1", D(2024, 1, 1), None, None, None), ("a", "e3", D(2024, 2, 1), "pricing", None, True),
            ("a", "e2", D(2024, 2, 1), "support", None, False), ("b", "e4", None, None, 2.5, False),
        ],
        "account_id string, churn_event_id string, churn_date date, reason_code string, refund_amount_usd double, "
        "is_reactivation boolean",
    )
    assert rows(U.churn_summary(df), "account_id") == [("a", "support", 0.0, True), ("b", None, 2.5, False)]


def test_usage_summary_matches_brute_force_with_a_hot_subscription(spark):
    """One subscription holds most rows, one account most subscriptions; repeated pairs count once."""
    usage = spark.range(6000).select(
        F.col("id").alias("usage_id"),
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("subscription_id"),
        F.concat(F.lit("f"), F.col("id") % 11).alias("feature_name"),
        F.when(F.col("id") % 13 > 0, F.col("id") % 7).alias("usage_count"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 60).alias("usage_duration_secs"),
        (F.col("id") % 2).alias("error_count"),
        (F.col("id") % 10 == 0).alias("is_beta_feature"),
    )
    subs = spark.range(45).select(
        F.col("id").alias("subscription_id"), F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("account_id")
    )
    subs = subs.union(subs)
    owner = {r.subscription_id: r.account_id for r in subs.collect()}
    expected = defaultdict(lambda: [0, 0, 0, 0, 0, 0, set()])
    for r in usage.collect():
        if r.subscription_id in owner:
            e = expected[owner[r.subscription_id]]
            e[0] += 1
            e[1] += r.usage_count or 0
            e[2] += r.usage_duration_secs or 0
            e[3] += r.usage_duration_secs is not None
            e[4] += r.error_count
            e[5] += r.is_beta_feature
            e[6].add(r.feature_name)
    got = {r[0]: tuple(r)[1:] for r in U.usage_summary(usage, subs).collect()}
    assert got == {
        a: (e[0], e[1], e[2] / e[3] if e[3] else None, e[4], e[5], len(e[6])) for a, e in expected.items()
    }


def test_master_has_one_row_per_account_and_the_contract_columns(spark, folder):
    tables = business_tables(spark, folder)
    master = build_master(tables, D(1997, 1, 1))
    assert len(master.columns) == 36 and master.columns[-2:] == ["tenure_days", "churn_label"]
    assert master.count() == tables["accounts"].count() == master.select("account_id").distinct().count()


def test_missing_churn_flag_comes_from_the_subscription(spark, folder):
    tables = business_tables(spark, folder)
    tables["accounts"] = tables["accounts"].withColumn("churn_flag", F.lit(None).cast("boolean"))
    master = build_master(tables, D(1997, 1, 1))
    assert master.filter(~F.col("churn_flag").eqNullSafe(F.col("sub_churn_flag"))).count() == 0


def test_kpis_of_nobody_on_trial(spark):
    df = spark.createDataFrame(
        [(True, 10, 120, 1.0, 2.0, 3.0, False), (False, None, None, None, None, None, None)],
        "churn_flag boolean, mrr_amount int, arr_amount int, avg_resolution_hrs double, avg_first_response_mins double, "
        "avg_satisfaction double, sub_is_trial boolean",
    )
    text = {r.kpi: r.value for r in kpi_text(kpis(df)).collect()}
    assert text["Trial Churn Rate (%)"] == "N/A" and text["Churn Rate (%)"] == "50.0"
    assert text["Average MRR (USD)"] == "$10" and text["Avg Satisfaction Score"] == "3.00 / 5"


def test_breakdowns_leave_out_missing_keys_and_order_ties(spark):
    df = spark.createDataFrame(
        [("x", True), ("x", False), ("y", True), ("z", False), ("w", False), (None, True), ("v", None)],
        "industry string, churn_flag boolean",
    )
    got = [tuple(r) for r in churn_rate_by(df, "industry").collect()]
    assert got == [("y", 100.0), ("x", 50.0), ("w", 0.0), ("z", 0.0), ("v", None)]
    reasons = spark.createDataFrame([("p",), ("q",), ("p",), (None,)], "reason_code string")
    assert [tuple(r) for r in churn_reason_counts(reasons).collect()] == [("p", 2), ("q", 1)]
