"""The five business tables as views over an order-processing star schema.

A customer is an account, an order a subscription, an order line a usage record; events are
support tickets, sign-up events stand for churn events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns the views read. Stating them spares the footer-reading job of schema inference.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    first_order = (
        _read(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.min(F.expr("cast(o_orderdate as date)")).alias("signup_date"))
    )
    return (
        _read(spark, folder, "customer")
        .join(_read(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(first_order, F.expr("c_custkey = o_custkey"), "left")
        .selectExpr(
            "c_custkey as account_id",
            "c_name as account_name",
            "c_mktsegment as industry",
            "n_name as country",
            "signup_date",
            "decode(n_regionkey, 0, 'organic', 1, 'ads', 2, 'event', 3, 'partner', 4, 'other') as referral_source",
            "decode(c_custkey % 3, 0, 'Basic', 1, 'Pro', 2, 'Enterprise') as plan_tier",
            "cast(1 + c_custkey % 50 as int) as seats",
            "c_custkey % 7 = 0 as is_trial",
            "c_custkey * 7919 % 100 < 22 as churn_flag",
        )
    )


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    mrr = "if(o_orderkey % 6 = 0, 0L, cast(floor(o_totalprice / 100) as bigint))"
    return _read(spark, folder, "orders").selectExpr(
        "o_orderkey as subscription_id",
        "o_custkey as account_id",
        "cast(o_orderdate as date) as start_date",
        "decode(o_orderstatus, 'F', 'Basic', 'O', 'Pro', 'P', 'Enterprise') as plan_tier",
        f"{mrr} as mrr_amount",
        f"12 * {mrr} as arr_amount",
        "o_orderkey % 6 = 0 as is_trial",
        "o_orderkey % 10 = 1 as upgrade_flag",
        "o_orderkey % 20 = 3 as downgrade_flag",
        "o_orderkey % 10 = 5 as churn_flag",
        "if(o_orderkey % 2 = 0, 'monthly', 'annual') as billing_frequency",
        "o_orderkey % 5 <> 0 as auto_renew_flag",
    )


def feature_usage(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as usage_id",
        "l_orderkey as subscription_id",
        "cast(l_shipdate as date) as usage_date",
        "concat('feature_', l_partkey % 40) as feature_name",
        "cast(l_quantity as int) as usage_count",
        "cast(floor(l_extendedprice / 10) as int) as usage_duration_secs",
        "cast(round(l_discount * 100) as int) as error_count",
        "l_suppkey % 10 = 0 as is_beta_feature",
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    # event values carry two decimals; the exact type keeps sums independent of task order
    return _read(spark, folder, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "cast(value as decimal(18,2)) as value",
        "cast(get_json_object(props, '$.k') as int) as k",
    )


def support_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _events(spark, folder)
        .filter("event_type <> 'signup'")
        .selectExpr(
            "event_id as ticket_id",
            "user_id as account_id",
            "ts as submitted_at",
            "value as resolution_time_hours",
            "decode(event_type, 'error', 'urgent', 'purchase', 'high', 'click', 'medium', 'view', 'low') as priority",
            "k as first_response_time_minutes",
            "if(k % 4 <> 0, 1 + k % 5, null) as satisfaction_score",
            "value > 100 as escalation_flag",
        )
    )


def churn_events(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _events(spark, folder)
        .filter("event_type = 'signup'")
        .selectExpr(
            "event_id as churn_event_id",
            "user_id as account_id",
            "cast(ts as date) as churn_date",
            "decode(k % 6, 0, 'pricing', 1, 'support', 2, 'features', 3, 'budget', 4, 'competitor', 5, 'unknown')"
            " as reason_code",
            "if(k % 4 = 0, value, cast(0 as decimal(18,2))) as refund_amount_usd",
            "k % 10 = 0 as is_reactivation",
        )
    )


VIEWS = {
    "accounts": accounts,
    "subscriptions": subscriptions,
    "feature_usage": feature_usage,
    "support_tickets": support_tickets,
    "churn_events": churn_events,
}


def business_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: view(spark, folder) for name, view in VIEWS.items()}
