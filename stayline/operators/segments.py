"""Derived metrics and the three customer segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.columns import cut, finite_or_null, flags_to_int, safe_ratio, to_numeric
from stayline.operators.ordering import keys_at_places
from stayline.operators.selection import Target, values_at_ranks
from stayline.session import durable

# Feature columns, segment names and bin edges of the reports.
FLAG_COLUMNS = ("is_trial", "sub_is_trial", "auto_renew_flag", "upgrade_flag", "downgrade_flag")

NUMERIC_COLUMNS = (
    "tenure_days", "seats", "mrr_amount", "arr_amount",
    "ticket_count", "avg_resolution_hrs", "avg_first_response_mins", "avg_satisfaction",
    "escalation_count", "urgent_ticket_count",
    "total_usage_events", "total_usage_count", "avg_duration_secs", "total_errors",
    "beta_feature_uses", "unique_features",
)

DERIVED_COLUMNS = (
    "tenure_months", "tickets_per_month", "usage_events_per_month", "avg_usage_per_event",
    "errors_per_100_usage", "usage_per_feature", "revenue_per_seat", "escalation_rate",
)

VALUE_LABELS = ("Low Value", "Mid Value", "High Value")
TENURE_EDGES = (-1, 180, 540, 999999)
TENURE_LABELS = ("New (<6m)", "Mid (6-18m)", "Loyal (>18m)")
ENGAGEMENT_EDGES = (-1, 5, 20, 999999)
ENGAGEMENT_LABELS = ("Low Engagement", "Mid Engagement", "High Engagement")
UNKNOWN = "Unknown"

DAYS_PER_MONTH = 30.0

# metric -> (factor, numerator, denominator)
RATIOS = {
    "tickets_per_month": (1, "ticket_count", "tenure_months"),
    "usage_events_per_month": (1, "total_usage_events", "tenure_months"),
    "avg_usage_per_event": (1, "total_usage_count", "total_usage_events"),
    "errors_per_100_usage": (100, "total_errors", "total_usage_count"),
    "usage_per_feature": (1, "total_usage_count", "unique_features"),
    "revenue_per_seat": (1, "mrr_amount", "seats"),
    "escalation_rate": (1, "escalation_count", "ticket_count"),
}


def derive_features(master: DataFrame) -> DataFrame:
    """Flags as 0/1 and the eight derived metrics, as far as their inputs exist."""
    df = to_numeric(flags_to_int(master, FLAG_COLUMNS), NUMERIC_COLUMNS)
    tenure = F.col("tenure_days") / DAYS_PER_MONTH if "tenure_days" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("tenure_months", tenure)
    df = df.withColumns({
        metric: safe_ratio(factor * F.col(top), F.col(bottom))
        for metric, (factor, top, bottom) in RATIOS.items()
        if top in df.columns and bottom in df.columns
    })
    return finite_or_null(df)


def value_segment(df: DataFrame) -> DataFrame:
    """Equal-count thirds by MRR (missing counts as 0), ties ordered by ``account_id``.

    Only the two boundary accounts are looked up: first the amount at their rank, then, among the accounts of that
    amount alone, the account. Every row then compares itself with them. Rank r of n is low while 3(r-1) < n-1 and mid
    while 3(r-1) < 2(n-1).
    """
    if "mrr_amount" not in df.columns:
        return df.withColumn("value_segment", F.lit(UNKNOWN))
    mrr = F.coalesce(F.col("mrr_amount"), F.lit(0).cast(df.schema["mrr_amount"].dataType))
    keys = durable(df.select(mrr.alias("mrr"), "account_id"), "amounts")
    low, mid, high = VALUE_LABELS
    lasts = {low: lambda n: (n + 1) // 3, mid: lambda n: 2 * n // 3}
    targets = [Target(label, F.col("mrr"), lambda n, rank=rank: (rank(n),) if rank(n) else ()) for label, rank in lasts.items()]
    found = {label: hits[0] for label, hits in values_at_ranks(keys, targets).items() if hits}
    # amounts that accounts on both sides of a boundary share
    shared = {label: lasts[label](hit.total) - hit.before for label, hit in found.items() if hit.before + hit.equal > lasts[label](hit.total)}
    accounts = keys_at_places(keys, "account_id", {label: (F.col("mrr") == F.lit(found[label].value), place) for label, place in shared.items()})
    segment = F.lit(high)
    for label, hit in reversed(found.items()):
        equal = F.col("account_id") <= F.lit(accounts[label]) if label in accounts else F.lit(True)
        upto = (mrr < F.lit(hit.value)) | ((mrr == F.lit(hit.value)) & equal)
        segment = F.when(upto, label).otherwise(segment)
    return df.withColumn("value_segment", segment)


def tenure_segment(df: DataFrame) -> DataFrame:
    if "tenure_days" not in df.columns:
        return df.withColumn("tenure_segment", F.lit(UNKNOWN))
    return df.withColumn("tenure_segment", cut(F.col("tenure_days"), TENURE_EDGES, TENURE_LABELS))


def engagement_segment(df: DataFrame) -> DataFrame:
    if "total_usage_events" not in df.columns:
        return df.withColumn("engagement_segment", F.lit(UNKNOWN))
    events = F.coalesce(F.col("total_usage_events"), F.lit(0))
    return df.withColumn("engagement_segment", cut(events, ENGAGEMENT_EDGES, ENGAGEMENT_LABELS))


def add_segments(df: DataFrame) -> DataFrame:
    return engagement_segment(tenure_segment(value_segment(df)))


def segment_counts(df: DataFrame, segment: str) -> DataFrame:
    """Accounts per segment, largest first; accounts without a segment are a row of their own."""
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(segment))
