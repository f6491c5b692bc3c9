"""Headline figures and churn breakdowns of the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import number_text, rate_pct, sum_or_zero, usd_text

# Dimensions of the breakdowns -> ascending order
BREAKDOWNS = {
    "sub_plan_tier": True,
    "industry": False,
    "referral_source": False,
    "billing_frequency": True,
}


def kpis(master: DataFrame) -> DataFrame:
    """One row of figures in one pass.

    Support figures are means of the accounts' own means. Revenue at risk is the MRR of the latest
    subscription of churned accounts.
    """
    churned = F.col("churn_flag")
    return master.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        rate_pct(churned).alias("churn_rate_pct"),
        (100 - rate_pct(churned)).alias("retention_rate_pct"),
        F.avg("mrr_amount").cast("double").alias("avg_mrr"),
        F.avg("arr_amount").cast("double").alias("avg_arr"),
        sum_or_zero(F.when(churned, F.col("mrr_amount"))).alias("revenue_at_risk"),
        F.avg("avg_resolution_hrs").alias("avg_resolution_hrs"),
        F.avg("avg_first_response_mins").alias("avg_first_response_mins"),
        F.avg("avg_satisfaction").alias("avg_satisfaction"),
        rate_pct(F.when(F.col("sub_is_trial"), churned)).alias("trial_churn_rate_pct"),
    )


def kpi_text(figures: DataFrame) -> DataFrame:
    """The figures as (position, kpi, value) rows, formatted for people."""
    trial = F.col("trial_churn_rate_pct")
    # Names of the figures as people read them.
    texts = [
        ("Total Accounts", F.col("total_accounts").cast("string")),
        ("Churn Rate (%)", number_text(F.col("churn_rate_pct"), 1)),
        ("Retention Rate (%)", number_text(F.col("retention_rate_pct"), 1)),
        ("Average MRR (USD)", usd_text(F.col("avg_mrr"))),
        ("Average ARR (USD)", usd_text(F.col("avg_arr"))),
        ("Revenue at Risk (MRR, USD)", usd_text(F.col("revenue_at_risk"))),
        ("Avg Support Resolution (hrs)", number_text(F.col("avg_resolution_hrs"), 1)),
        ("Avg First Response (min)", number_text(F.col("avg_first_response_mins"), 0)),
        ("Avg Satisfaction Score", F.concat(number_text(F.col("avg_satisfaction"), 2), F.lit(" / 5"))),
        ("Trial Churn Rate (%)", F.when(trial.isNull(), "N/A").otherwise(number_text(trial, 1))),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("kpi"), text.alias("value"))
        for i, (name, text) in enumerate(texts, start=1)
    ])
    return figures.select(F.inline(rows))


def churn_rate_by(master: DataFrame, dimension: str, ascending: bool | None = None) -> DataFrame:
    """Churn percentage per value of a dimension; accounts without a value are left out."""
    if ascending is None:
        ascending = BREAKDOWNS.get(dimension, True)
    order = F.asc_nulls_last if ascending else F.desc_nulls_last
    return (
        master.filter(F.col(dimension).isNotNull())
        .groupBy(dimension)
        .agg(rate_pct(F.col("churn_flag")).alias("churn_rate_pct"))
        .orderBy(order("churn_rate_pct"), dimension)
    )


def churn_reason_counts(churn_events: DataFrame) -> DataFrame:
    return (
        churn_events.na.drop(subset=["reason_code"])
        .groupBy("reason_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason_code")
    )
