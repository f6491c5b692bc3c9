"""Retention priority, recommended action and business impact of scored accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import sum_or_zero, usd_text

# Priority names, actions and thresholds.
P1 = "P1 — High Value, High Risk"
P2 = "P2 — Mid Value, High Risk"
P3 = "P3 — Low Value, High Risk"
P4 = "P4 — Low Risk"

ACTIONS = {
    P1: "Immediate call + custom discount",
    P2: "Targeted email + support follow-up",
    P3: "Automated nudges / offers",
    P4: "Upsell / loyalty program",
}

HIGH_VALUE_RISK = 0.60
MID_VALUE_RISK = 0.50
ANY_VALUE_RISK = 0.40

ACTION_COLUMNS = ("account_name", "industry", "mrr_amount", "churn_probability", "retention_priority")


def _known_probability() -> Column:
    """NaN compares above every number in Spark; here it must compare as unknown."""
    return F.when(~F.isnan("churn_probability"), F.col("churn_probability"))


def add_priority(scored: DataFrame) -> DataFrame:
    """First matching rule wins. P3 has no value test, so it also takes the high and mid value
    accounts below their own thresholds; an unknown probability is P4."""
    p, segment = _known_probability(), F.col("value_segment")
    return scored.withColumn(
        "retention_priority",
        F.when((segment == "High Value") & (p >= HIGH_VALUE_RISK), P1)
        .when((segment == "Mid Value") & (p >= MID_VALUE_RISK), P2)
        .when(p >= ANY_VALUE_RISK, P3)
        .otherwise(P4),
    )


def add_action(df: DataFrame) -> DataFrame:
    action = F.lit(None).cast("string")
    for priority, text in ACTIONS.items():
        action = F.when(F.col("retention_priority") == priority, text).otherwise(action)
    return df.withColumn("recommended_action", action)


def top_accounts(scored: DataFrame, n: int = 20) -> DataFrame:
    """The accounts most likely to churn, ties by ``account_id``, unknown probabilities last."""
    top = (
        scored.withColumn("churn_probability", _known_probability())
        .orderBy(F.desc_nulls_last("churn_probability"), "account_id")
        .limit(n)
    )
    return add_action(top.select(*ACTION_COLUMNS))


def by_priority(scored: DataFrame) -> DataFrame:
    """Accounts, mean probability and MRR of every priority, absent ones included.

    An absent priority has count 0 and no mean or revenue.
    """
    priorities = F.array(*map(F.lit, ACTIONS))
    spine = scored.sparkSession.range(1, numPartitions=1).select(F.explode(priorities).alias("retention_priority"))
    found = scored.groupBy("retention_priority").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.avg(_known_probability()).alias("mean_probability"),
        sum_or_zero("mrr_amount").alias("mrr"),
    )
    return (
        spine.join(F.broadcast(found), "retention_priority", "left")  # at most four rows
        .withColumn("accounts", F.coalesce("accounts", F.lit(0)))
        .orderBy("retention_priority")
    )


def priority_counts(scored: DataFrame) -> DataFrame:
    return by_priority(scored).select("retention_priority", "accounts")


def priority_mean_probability(scored: DataFrame) -> DataFrame:
    return by_priority(scored).select("retention_priority", "mean_probability")


def priority_mrr(scored: DataFrame) -> DataFrame:
    return by_priority(scored).select("retention_priority", "mrr")


def business_impact(scored: DataFrame) -> DataFrame:
    """Revenue at risk, revenue of P1 and number of P1 accounts, in one pass."""
    is_p1 = F.col("retention_priority") == P1
    mrr = F.col("mrr_amount")
    return scored.agg(
        sum_or_zero(F.when(_known_probability() >= ANY_VALUE_RISK, mrr)).alias("predicted_revenue_at_risk"),
        sum_or_zero(F.when(is_p1, mrr)).alias("p1_revenue_at_risk"),
        F.count_if(is_p1).alias("high_value_customers_at_risk"),
    )


def impact_text(impact: DataFrame) -> DataFrame:
    """The impact figures as they are shown to people."""
    return impact.select(
        usd_text(F.col("predicted_revenue_at_risk")).alias("predicted_revenue_at_risk"),
        usd_text(F.col("p1_revenue_at_risk")).alias("p1_revenue_at_risk"),
        F.col("high_value_customers_at_risk").cast("string").alias("high_value_customers_at_risk"),
    )
