"""The master table: one row per account."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import fill_zero, to_numeric
from stayline.operators.summaries import churn_summary, latest_subscription, support_summary, usage_summary

# Columns where missing means no activity, and columns that must be numeric.
NO_ACTIVITY_COLUMNS = (
    "ticket_count",
    "escalation_count",
    "urgent_ticket_count",
    "total_usage_events",
    "total_usage_count",
    "total_errors",
    "beta_feature_uses",
)

MEASURES = (
    "mrr_amount",
    "arr_amount",
    "avg_resolution_hrs",
    "avg_first_response_mins",
    "avg_satisfaction",
    "refund_usd",
    "avg_duration_secs",
)


def build_master(tables: dict[str, DataFrame], as_of: date | None = None) -> DataFrame:
    """Accounts with their latest subscription, support, usage and churn summaries.

    Both sides of each join have one row per account, so no join fans out. ``as_of`` is the day
    tenure is counted to, today by default.
    """
    master = tables["accounts"]
    for summary in (
        latest_subscription(tables["subscriptions"]),
        support_summary(tables["support_tickets"]),
        usage_summary(tables["feature_usage"], tables["subscriptions"]),
        churn_summary(tables["churn_events"]),
    ):
        master = master.join(summary, "account_id", "left")
    if "churn_flag" in master.columns and "sub_churn_flag" in master.columns:
        master = master.withColumn("churn_flag", F.coalesce("churn_flag", "sub_churn_flag"))
    master = to_numeric(fill_zero(master, NO_ACTIVITY_COLUMNS), MEASURES)
    today = F.current_date() if as_of is None else F.lit(as_of)
    return master.withColumns({
        "tenure_days": F.date_diff(today, F.col("signup_date").cast("date")),
        "churn_label": F.when(F.col("churn_flag"), "churned").when(~F.col("churn_flag"), "retained"),
    })
