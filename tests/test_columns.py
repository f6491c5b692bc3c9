import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.functions import columns as C
from stayline.operators import segments as S


def values(df, name="out"):
    return [r[name] for r in df.collect()]


def test_safe_ratio_gives_null_for_zero_and_missing(spark):
    df = spark.createDataFrame([(4, 2), (1, 0), (None, 2), (1, None), (None, 0)], "a int, b int")
    assert values(df.select(C.safe_ratio(F.col("a"), F.col("b")).alias("out"))) == [2.0, None, None, None, None]


def test_mean_and_sum_of_all_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "a int")
    row = df.agg(C.mean_of(F.col("a")).alias("m"), C.sum_or_zero("a").alias("s")).first()
    assert row.m is None and row.s == 0


@pytest.mark.parametrize("part,whole", [(0, 7), (1, 3), (2, 3), (1, 8), (3, 8), (7, 7), (1, 16), (5, 0)])
def test_percent_rounds_half_up(spark, part, whole):
    out = spark.range(1).select(C.percent_1dp(F.lit(part), F.lit(whole)).alias("out")).first().out
    expected = None if whole == 0 else math.floor((2000 * part + whole) / (2 * whole)) / 10
    assert out == expected


@pytest.mark.parametrize(
    "add,column,edges,labels,points",
    [
        (S.tenure_segment, "tenure_days", S.TENURE_EDGES, S.TENURE_LABELS,
         [-2, -1, 0, 180, 181, 540, 541, 999999, 1000000, None]),
        (S.engagement_segment, "total_usage_events", S.ENGAGEMENT_EDGES, S.ENGAGEMENT_LABELS,
         [0, 5, 6, 20, 21]),
    ],
)
def test_bins_are_closed_on_the_right(spark, add, column, edges, labels, points):
    df = spark.createDataFrame([(p,) for p in points], f"{column} int").coalesce(1)
    name = column.split("_")[0] if column == "tenure_days" else "engagement"
    got = values(add(df), f"{name}_segment")
    expected = pd.cut(pd.Series(points, dtype="float"), list(edges), labels=list(labels))
    assert got == [None if pd.isna(e) else e for e in expected]


def test_missing_engagement_counts_as_low(spark):
    df = spark.createDataFrame([(None,)], "total_usage_events int")
    assert values(S.engagement_segment(df), "engagement_segment") == ["Low Engagement"]


def test_segments_of_absent_columns_are_unknown(spark):
    row = S.add_segments(spark.createDataFrame([("a",)], "account_id string")).first()
    assert {row.value_segment, row.tenure_segment, row.engagement_segment} == {"Unknown"}


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert values(C.finite_or_null(df), "x") == [None, None, None, 1.5, None]
    assert values(C.nan_to_null(df), "x") == [None, float("inf"), float("-inf"), 1.5, None]


def test_text_numbers_are_read_leniently(spark):
    df = spark.createDataFrame([("12",), ("1e2",), ("n/a",), (None,)], "x string")
    assert values(C.to_numeric(df, ["x", "absent"]), "x") == [12.0, 100.0, None, None]


def test_flags(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_trial boolean")
    assert values(C.flags_to_int(df, ["is_trial", "absent"]), "is_trial") == [1, 0, None]


@pytest.mark.parametrize("x", [0.25, 2.5, 3.5, 1234.56, 99.95, 1e7 + 0.5])
def test_number_text_matches_python_formatting(spark, x):
    row = spark.range(1).select(
        C.number_text(F.lit(x), 1).alias("a"), C.usd_text(F.lit(x)).alias("b"), C.number_text(F.lit(None), 1).alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (f"{x:.1f}", f"${x:,.0f}", "nan")


def test_derived_metrics_guard_every_divisor(spark):
    columns = [
        "tenure_days", "ticket_count", "total_usage_events", "total_usage_count", "total_errors", "unique_features",
        "mrr_amount", "seats", "escalation_count",
    ]
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 10, 0, 0), (60, 4, 2, 10, 1, 5, 100, 4, 1)],
                               ", ".join(f"{c} int" for c in columns)).coalesce(1)
    empty, full = S.derive_features(df).select(*S.DERIVED_COLUMNS).collect()
    assert empty.tenure_months == 0 and all(v is None for k, v in empty.asDict().items() if k != "tenure_months")
    assert tuple(full) == (2.0, 2.0, 1.0, 5.0, 10.0, 2.0, 25.0, 0.25)


def test_derived_metrics_need_only_what_is_there(spark):
    df = S.derive_features(spark.createDataFrame([(3, 1)], "ticket_count int, escalation_count int"))
    assert df.columns == ["ticket_count", "escalation_count", "tenure_months", "tickets_per_month", "escalation_rate"]
    row = df.first()
    assert row.tenure_months is None and np.isclose(row.escalation_rate, 1 / 3)
