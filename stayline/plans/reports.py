"""The eight business reports, straight from the business tables.

Missing group keys form a group of their own here, as in SQL. The two reports over accounts and all
their subscriptions reduce the subscriptions to one row per account before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import mean_of, percent_1dp, safe_ratio

# Longest resolution in hours that keeps the service level, by priority.
SLA_HOURS = {"urgent": 4, "high": 8, "medium": 24, "low": 48}


def churn_by(accounts: DataFrame, dimension: str) -> DataFrame:
    """Accounts, churned accounts and churn percentage per value of a dimension."""
    total, churned = F.count(F.lit(1)), F.count_if("churn_flag")
    return (
        accounts.groupBy(dimension)
        .agg(
            total.alias("total_customers"),
            churned.alias("churned_customers"),
            percent_1dp(churned, total).alias("churn_rate_pct"),
        )
        .orderBy(F.desc("churn_rate_pct"), F.asc_nulls_last(dimension))
    )


def churn_by_plan(accounts: DataFrame) -> DataFrame:
    """By the plan an account started with."""
    return churn_by(accounts, "plan_tier")


def churn_by_industry(accounts: DataFrame) -> DataFrame:
    return churn_by(accounts, "industry")


def revenue_at_risk(accounts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """MRR over every subscription, split by whether the account churned."""
    owned = subscriptions.groupBy("account_id").agg(F.sum("mrr_amount").alias("mrr"))
    churned, mrr = F.col("churn_flag"), F.col("mrr")
    return (
        accounts.select("account_id", "churn_flag")
        .join(owned, "account_id")
        .agg(
            F.sum(F.when(churned, mrr).otherwise(0)).alias("churned_mrr"),
            F.sum(F.when(~churned, mrr).otherwise(0)).alias("active_mrr"),
            F.sum(mrr).alias("total_mrr"),
        )
    )


def sla_breaches(tickets: DataFrame) -> DataFrame:
    hours = F.col("resolution_time_hours")
    breach = F.lit(False)
    for priority, limit in SLA_HOURS.items():
        breach = F.when(F.col("priority") == priority, hours > limit).otherwise(breach)
    return tickets.groupBy("priority").agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.round(mean_of(hours), 1).alias("avg_resolution_hours"),
        F.count_if(breach).alias("sla_breaches"),
    )


def feature_errors(usage: DataFrame) -> DataFrame:
    uses, errors = F.sum("usage_count"), F.sum("error_count")
    return (
        usage.groupBy("feature_name")
        .agg(
            uses.alias("total_usage"),
            errors.alias("total_errors"),
            F.round(safe_ratio(100 * errors, uses), 2).alias("error_rate_pct"),
        )
        .orderBy(F.desc_nulls_last("total_usage"), F.asc_nulls_last("feature_name"))
    )


def churn_reasons(churn_events: DataFrame) -> DataFrame:
    return (
        churn_events.groupBy("reason_code")
        .agg(
            F.count(F.lit(1)).alias("churn_count"),
            F.round(mean_of(F.col("refund_amount_usd")), 2).alias("avg_refund_usd"),
        )
        .orderBy(F.desc("churn_count"), F.asc_nulls_last("reason_code"))
    )


def top_customers(accounts: DataFrame, subscriptions: DataFrame, n: int = 10) -> DataFrame:
    """Customers by their largest MRR; equal MRR in order of name and industry."""
    best = subscriptions.groupBy("account_id").agg(F.max("mrr_amount").alias("mrr"))
    return (
        accounts.select("account_id", "account_name", "industry")
        .join(best, "account_id")
        .groupBy("account_name", "industry")
        .agg(F.max("mrr").alias("mrr"))
        .orderBy(F.desc_nulls_last("mrr"), F.asc_nulls_last("account_name"), F.asc_nulls_last("industry"))
        .limit(n)
    )


def signup_cohorts(accounts: DataFrame) -> DataFrame:
    """Churn by month of sign-up."""
    total, churned = F.count(F.lit(1)), F.count_if("churn_flag")
    return (
        accounts.groupBy(F.trunc("signup_date", "MM").alias("cohort_month"))
        .agg(
            total.alias("total_customers"),
            churned.alias("churned"),
            percent_1dp(churned, total).alias("churn_rate_pct"),
        )
        .orderBy("cohort_month")
    )


def all_reports(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    accounts, subscriptions = tables["accounts"], tables["subscriptions"]
    return {
        "churn_by_plan": churn_by_plan(accounts),
        "churn_by_industry": churn_by_industry(accounts),
        "revenue_at_risk": revenue_at_risk(accounts, subscriptions),
        "sla_breaches": sla_breaches(tables["support_tickets"]),
        "feature_errors": feature_errors(tables["feature_usage"]),
        "churn_reasons": churn_reasons(tables["churn_events"]),
        "top_customers": top_customers(accounts, subscriptions),
        "signup_cohorts": signup_cohorts(accounts),
    }
