"""One row per account from each detail table.

Every summary reduces map-side before its exchange, so an account or subscription holding a large
share of the rows costs one partial row per task. Each output is the result of a ``groupBy`` on
``account_id``, which also lets the optimizer drop a left join whose columns nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.columns import mean_of, present, safe_ratio, sum_or_zero

# Subscription columns of the master table and their names there.
LATEST_COLUMNS = (
    "plan_tier",
    "mrr_amount",
    "arr_amount",
    "billing_frequency",
    "is_trial",
    "upgrade_flag",
    "downgrade_flag",
    "churn_flag",
    "auto_renew_flag",
)

LATEST_RENAMES = {
    "plan_tier": "sub_plan_tier",
    "is_trial": "sub_is_trial",
    "churn_flag": "sub_churn_flag",
}


def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """The subscription with the greatest start date of each account.

    Ties go to the lowest ``subscription_id``; an account whose dates are all missing keeps its
    lowest ``subscription_id``. Subscriptions without an account are left out.
    """
    kept = present(subscriptions, LATEST_COLUMNS)
    started = F.col("start_date")
    if isinstance(subscriptions.schema["start_date"].dataType, T.DateType):
        moment = F.unix_date(started)
    else:
        moment = F.unix_micros(started.cast("timestamp"))
    newest_first = F.struct(
        started.isNull().alias("undated"),
        (-moment).alias("recency"),
        "subscription_id",
        *kept,
    )
    owned = subscriptions.filter(F.col("account_id").isNotNull())
    best = owned.groupBy("account_id").agg(F.min(newest_first).alias("best"))
    return best.select(
        "account_id", *[F.col(f"best.{c}").alias(LATEST_RENAMES.get(c, c)) for c in kept]
    )


def support_summary(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(
            F.count("ticket_id").alias("ticket_count"),
            mean_of(F.col("resolution_time_hours")).alias("avg_resolution_hrs"),
            mean_of(F.col("first_response_time_minutes")).alias("avg_first_response_mins"),
            mean_of(F.col("satisfaction_score")).alias("avg_satisfaction"),
            F.count_if("escalation_flag").alias("escalation_count"),
            F.count_if(F.col("priority") == "urgent").alias("urgent_ticket_count"),
        )
    )


def usage_summary(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Usage totals and distinct features of each account, over all its subscriptions.

    The largest table. Usage is first reduced to one row per subscription and feature, so neither
    the join nor the account grouping ever carries the raw rows of a hot subscription. Keeping the
    feature in the key leaves the distinct count exact.
    """
    per_feature = (
        usage.filter(F.col("subscription_id").isNotNull())
        .groupBy("subscription_id", "feature_name")
        .agg(
            F.count("usage_id").alias("events"),
            F.sum("usage_count").alias("uses"),
            F.sum("usage_duration_secs").alias("secs"),
            F.count("usage_duration_secs").alias("timed"),
            F.sum("error_count").alias("errors"),
            F.count_if("is_beta_feature").alias("beta"),
        )
    )
    pairs = subscriptions.filter(F.col("subscription_id").isNotNull() & F.col("account_id").isNotNull())
    owner = pairs.select("subscription_id", "account_id").distinct()
    return (
        per_feature.join(owner, "subscription_id")
        .groupBy("account_id")
        .agg(
            F.sum("events").alias("total_usage_events"),
            sum_or_zero("uses").alias("total_usage_count"),
            safe_ratio(F.sum("secs"), F.sum("timed")).alias("avg_duration_secs"),
            sum_or_zero("errors").alias("total_errors"),
            F.sum("beta").alias("beta_feature_uses"),
            F.count_distinct("feature_name").alias("unique_features"),
        )
    )


def churn_summary(churn_events: DataFrame) -> DataFrame:
    """Earliest stated reason, total refund and whether any event was a reactivation."""
    first_reason = F.min(
        F.when(
            F.col("reason_code").isNotNull(),
            F.struct(F.col("churn_date").isNull().alias("undated"), "churn_date", "churn_event_id", "reason_code"),
        )
    )
    return (
        churn_events.filter(F.col("account_id").isNotNull())
        .groupBy("account_id")
        .agg(
            first_reason.alias("first"),
            sum_or_zero("refund_amount_usd").alias("refund_usd"),
            F.bool_or("is_reactivation").alias("is_reactivation"),
        )
        .select("account_id", F.col("first.reason_code").alias("churn_reason"), "refund_usd", "is_reactivation")
    )
