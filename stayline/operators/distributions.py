"""Histogram and box-plot data sets by churn label."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.ordering import quantiles, slice_in_order
from stayline.session import durable

# Churn labels of the master table.
LABELS = ("retained", "churned")

WHISKER = 1.5


def value_counts_by_label(master: DataFrame, column: str) -> DataFrame:
    """How often each value occurs among the retained and the churned."""
    return (
        master.filter(F.col("churn_label").isin(*LABELS) & F.col(column).isNotNull())
        .groupBy("churn_label", F.col(column).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(master: DataFrame, column: str = "mrr_amount", bins: int = 25) -> DataFrame:
    """Equal-width bins between the label's own extremes, empty bins included.

    Bins are closed on the left, the last one on both sides. A single repeated value is centred in a
    range of width 1.
    """
    # read twice, for the extremes and for the bins
    counted = durable(value_counts_by_label(master, column), "values")
    low, high = F.min("value"), F.max("value")
    half = F.when(low == high, 0.5).otherwise(0.0)
    # one row per label
    ranges = counted.groupBy("churn_label").agg((low - half).alias("low"), (high + half).alias("high"))
    width = (F.col("high") - F.col("low")) / bins

    def edge(index: Column) -> Column:
        return F.when(index == bins, F.col("high")).otherwise(F.col("low") + index * width)

    guess = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    # the quotient can land one bin off where a value sits on an edge
    exact = (
        F.when(F.col("value") < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (F.col("value") >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    filled = (
        counted.join(F.broadcast(ranges), "churn_label")
        .withColumn("guess", guess)
        .groupBy("churn_label", exact.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    spine = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(filled, ["churn_label", "bin"], "left").select(
        "churn_label",
        "bin",
        edge(F.col("bin")).alias("bin_left"),
        edge(F.col("bin") + 1).alias("bin_right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _fenced(master: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    sliced = slice_in_order(value_counts_by_label(master, column), ["value"], ["churn_label"])
    quarters = quantiles(
        sliced, "n", {"q1": Fraction(1, 4), "median": Fraction(1, 2), "q3": Fraction(3, 4)}
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    # quarters has one row per label
    rows = sliced.rows.join(F.broadcast(quarters), "churn_label").withColumn("inside", inside)
    return rows, quarters


def box_parts(master: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``box_stats`` and ``box_outliers`` of a column from one ordering of its values."""
    rows, _ = _fenced(master, column)
    return _stats(rows), _outliers(rows)


def box_stats(master: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR of the box) and outlier count by label."""
    return box_parts(master, column)[0]


def box_outliers(master: DataFrame, column: str) -> DataFrame:
    """The values outside the whiskers, with their number of accounts."""
    return box_parts(master, column)[1]


def _stats(rows: DataFrame) -> DataFrame:
    value = F.col("value")
    quarters = ["q1", "median", "q3"]
    return (
        rows.groupBy("churn_label", *quarters)
        .agg(
            F.sum("n").alias("n"),
            F.min(F.when(F.col("inside"), value)).alias("lowest"),
            F.max(F.when(F.col("inside"), value)).alias("highest"),
            F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("outliers"),
        )
        .select(
            "churn_label",
            "n",
            # a whisker never ends inside the box
            F.least("lowest", "q1").alias("whisker_low"),
            *quarters,
            F.greatest("highest", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def _outliers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("inside")).select("churn_label", "value", "n")
