from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators.distributions import box_outliers, box_stats, histogram
from stayline.operators.ordering import at_ranks, quantiles, running_totals, slice_in_order
from stayline.operators.segments import VALUE_LABELS, segment_counts, value_segment


def qcut_labels(mrr):
    ranks = pd.Series(mrr, dtype="float").fillna(0).rank(method="first")
    return list(pd.qcut(ranks, q=3, labels=list(VALUE_LABELS)))


@pytest.mark.parametrize(
    "mrr",
    [
        [5], [5, 1], [3, 1, 2], [4, 3, 2, 1], [7] * 5, [0] * 6 + [9, 8, 7], [None, 3, None, 1, 2, None, 0, 5, 5, 5],
        list(range(11)), [0] * 70 + list(range(31)), [(i * 37) % 10 for i in range(500)],
    ],
    ids=lambda m: f"n{len(m)}",
)
def test_value_segment_is_the_equal_count_cut_of_pandas(spark, mrr):
    df = spark.createDataFrame([(f"{i:05d}", m) for i, m in enumerate(mrr)], "account_id string, mrr_amount int")
    got = [r.value_segment for r in value_segment(df).orderBy("account_id").collect()]
    if len(mrr) == 1:
        assert got == ["High Value"]  # one account, nothing to divide
    else:
        assert got == [str(x) for x in qcut_labels(mrr)]


def test_segment_counts_keep_missing(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "s string")
    assert [tuple(r) for r in segment_counts(df, "s").collect()] == [(None, 2), ("a", 1)]


def skewed(spark, n=4000):
    """A third of all rows share one value."""
    value = F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1013) / 4.0)
    return spark.range(n).select("id", value.alias("v"), F.when(F.col("id") % 5 > 0, "x").otherwise("y").alias("g"))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_several_slices(spark, descending):
    counted = skewed(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    sliced = slice_in_order(counted, ["v"], ["g"], descending)
    got = running_totals(sliced, ["n", "s"]).toPandas().sort_values(["g", "v"], ascending=[True, not descending])
    for w in ("n", "s"):
        assert list(got[f"{w}_through"]) == list(got.groupby("g")[w].cumsum())
        assert list(got[f"{w}_total"]) == list(got.groupby("g")[w].transform("sum"))


def test_slices_of_explicit_partitions(spark):
    """The same with slices that adaptive execution cannot merge."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = slice_in_order(spark.range(1000).withColumn("n", F.lit(1)), ["id"])
        assert sliced.rows.select("_slice").distinct().count() > 1
        got = running_totals(sliced, ["n"]).filter("n_through <> id + 1 or n_total <> 1000").count()
        assert got == 0
        found = at_ranks(
            sliced, "n", {"first": lambda total: "1", "mid": lambda total: f"floor({total} / 2)", "none": lambda total: f"{total} + 1"}
        ).first()
        assert (found["first"].id, found["mid"].id, found["none"]) == (0, 499, None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_match_numpy(spark):
    df = skewed(spark)
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = {"a": Fraction(1, 4), "b": Fraction(1, 2), "c": Fraction(3, 4), "d": Fraction(9, 10)}
    got = {r.g: tuple(r)[1:] for r in quantiles(slice_in_order(counted, ["v"], ["g"]), "n", shares).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.v, [0.25, 0.5, 0.75, 0.9]))


def labelled(spark, retained, churned):
    data = [
        (label, None if v is None else float(v))
        for label, values in (("retained", retained), ("churned", churned))
        for v in values
    ]
    return spark.createDataFrame(data, "churn_label string, mrr_amount double")


def brute_box(values):
    x = np.array([v for v in values if v is not None])
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = x[(x >= low) & (x <= high)]
    out = sorted(x[(x < low) | (x > high)])
    return (len(x), min(inside.min(), q1), q1, med, q3, max(inside.max(), q3), len(out)), out


def test_box_stats_match_brute_force(spark):
    groups = {
        "retained": [1.0, 2, 3, 4, 100, None, -50, 2, 2],
        "churned": [5.0] * 40 + [6.0, 9.0, 9.0],
    }
    df = labelled(spark, groups["retained"], groups["churned"])
    stats = {r[0]: tuple(r)[1:] for r in box_stats(df, "mrr_amount").collect()}
    fliers = {}
    for r in box_outliers(df, "mrr_amount").collect():
        fliers.setdefault(r.churn_label, []).extend([r.value] * r.n)
    for label, values in groups.items():
        expected, out = brute_box(values)
        assert np.allclose(stats[label], expected)
        assert sorted(fliers.get(label, [])) == out


@pytest.mark.parametrize(
    "values", [[3.0], [3.0, 3.0], [0.0, 1, 2, 25], [i / 10 for i in range(101)], [0.1, 0.3, 0.7, None, 1.9]]
)
def test_histogram_matches_numpy(spark, values):
    got = histogram(labelled(spark, values, [1.0])).filter("churn_label = 'retained'").orderBy("bin").collect()
    counts, edges = np.histogram([v for v in values if v is not None], bins=25)
    assert [r.n for r in got] == list(counts)
    assert np.allclose([r.bin_left for r in got], edges[:-1]) and np.allclose([r.bin_right for r in got], edges[1:])
