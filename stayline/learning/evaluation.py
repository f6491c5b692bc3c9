"""Quality of scored rows, for a 0/1 ``label`` and a ``churn_probability``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.columns import safe_ratio
from stayline.operators.ordering import SLICE, Sliced, running_totals, slice_in_order

# Decision threshold and class names of the report.
THRESHOLD = 0.35
CLASS_NAMES = ("Retained", "Churned")


def _by_score(scored: DataFrame) -> Sliced:
    """Positives and negatives per distinct score, highest score first."""
    counted = (
        scored.filter(F.col("label").isNotNull() & F.col("churn_probability").isNotNull())
        .groupBy("churn_probability")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    return slice_in_order(counted, ["churn_probability"], descending=True)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order, a tie
    counting one half. Pairs are counted in whole numbers from totals per score."""
    rows = running_totals(_by_score(scored), ["pos", "neg"])
    wide = "decimal(19,0)"
    below = F.col("neg_total") - F.col("neg_through")
    twice_won = F.col("pos").cast(wide) * (2 * below + F.col("neg")).cast(wide)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
    return rows.agg(safe_ratio(F.sum(twice_won), 2 * pairs).alias("roc_auc"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) along the curve, from the origin at an infinite threshold.

    A score whose step equals the next one's lies on a straight line and is left out; the first and the last
    score always stay, so the drawn curve and its area are the same.
    """
    sliced = _by_score(scored)
    step = F.struct("pos", "neg")
    in_slice = Window.partitionBy(SLICE).orderBy(*sliced.order())
    # one row per slice
    over_slices = Window.partitionBy().orderBy(SLICE)
    following = (
        sliced.rows.groupBy(SLICE).agg(F.max_by(step, "churn_probability").alias("first"))
        .select(SLICE, F.lead("first").over(over_slices).alias("next_slice"))
    )
    rows = (
        running_totals(sliced, ["pos", "neg"])
        .join(F.broadcast(following), SLICE)
        .withColumn("next", F.coalesce(F.lead(step).over(in_slice), "next_slice"))
    )
    first = (F.col("pos_through") == F.col("pos")) & (F.col("neg_through") == F.col("neg"))
    points = rows.filter(first | F.col("next").isNull() | (F.col("next") != step)).select(
        F.col("churn_probability").alias("threshold"),
        safe_ratio(F.col("neg_through"), F.col("neg_total")).alias("fpr"),
        safe_ratio(F.col("pos_through"), F.col("pos_total")).alias("tpr"),
    )
    origin = rows.sparkSession.range(1, numPartitions=1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def predict_class(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """0/1 prediction: probability at or above the threshold."""
    return scored.withColumn("prediction", (F.col("churn_probability") >= threshold).cast("int"))


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(safe_ratio(numerator, denominator), F.lit(0.0))


def classification_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes, accuracy, macro and weighted averages.

    One pass counts the four cells of the confusion table; the rest is arithmetic on one row.
    """

    def cell(label: int, prediction: int) -> Column:
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    counts = predicted.agg(
        cell(0, 0).alias("c00"), cell(0, 1).alias("c01"), cell(1, 0).alias("c10"), cell(1, 1).alias("c11")
    )
    c00, c01, c10, c11 = (F.col(c) for c in ("c00", "c01", "c10", "c11"))
    total = c00 + c01 + c10 + c11

    def per_class(hit: Column, wrongly: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": _or_zero(hit, hit + wrongly),
            "recall": _or_zero(hit, hit + missed),
            "f1_score": _or_zero(2 * hit, 2 * hit + wrongly + missed),
            "support": hit + missed,
        }

    retained, churned = per_class(c00, c10, c01), per_class(c11, c01, c10)
    figures = ("precision", "recall", "f1_score")
    accuracy = _or_zero(c00 + c11, total)
    table = {
        CLASS_NAMES[0]: retained,
        CLASS_NAMES[1]: churned,
        "accuracy": {**{f: accuracy for f in figures}, "support": total},
        "macro avg": {**{f: (retained[f] + churned[f]) / 2 for f in figures}, "support": total},
        "weighted avg": {
            **{
                f: _or_zero(retained[f] * retained["support"] + churned[f] * churned["support"], total)
                for f in figures
            },
            "support": total,
        },
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("class_name"), *[column.alias(f) for f, column in row.items()])
        for name, row in table.items()
    ])
    return counts.select(F.inline(rows))


def class_weights(labelled: DataFrame) -> DataFrame:
    """Balanced weights n / (number of classes * n of the class)."""
    everything = Window.partitionBy()  # over one row per class
    return (
        labelled.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "weight",
            safe_ratio(F.sum("n").over(everything), F.count(F.lit(1)).over(everything) * F.col("n")),
        )
    )
