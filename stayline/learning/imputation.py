"""Values that stand in for missing ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.selection import Target, values_at_ranks
from stayline.session import small_table


def _stacked(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(feature, value, n): how often each value of each column occurs, counted map-side first."""
    values = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns
    ])
    return (
        df.select(F.inline(values))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median of every column, one row per column that has a value, in a few passes for all.

    ``df`` is read several times, so store it first.
    """

    def middle(n: int) -> tuple[int, ...]:
        return (n + 1) // 2, n // 2 + 1

    finite = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    found = values_at_ranks(df, [Target(c, value, middle) for c, value in finite.items()])
    rows = [(name, (low.value + high.value) / 2) for name, (low, high) in found.items()]
    return small_table(df.sparkSession, rows, "feature string, median double")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of every column; the lowest of equally frequent ones."""
    best = F.min(F.struct((-F.col("n")).alias("rarity"), "value"))
    return (
        _stacked(df, columns, "string")
        .groupBy("feature")
        .agg(best.alias("best"))
        .select("feature", F.col("best.value").alias("mode"))
    )
