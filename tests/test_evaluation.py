import itertools
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from stayline.learning import evaluation as E


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, churn_probability double")


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def sample(n, distinct, seed):
    r = random.Random(seed)
    return [(int(r.random() < 0.3), r.randrange(distinct) / distinct) for _ in range(n)]


@pytest.mark.parametrize("n,distinct", [(40, 3), (300, 50), (300, 10**6)])
def test_auc_equals_pair_counting_and_mllib(spark, n, distinct):
    rows = sample(n, distinct, n + distinct)
    df = frame(spark, rows)
    auc = E.roc_auc(df).first().roc_auc
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    mllib = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="churn_probability", numBins=0)
    assert auc == pytest.approx(mllib.evaluate(df), abs=1e-12)


def test_auc_of_one_class_is_unknown(spark):
    assert E.roc_auc(frame(spark, [(1, 0.2), (1, 0.4)])).first().roc_auc is None


def test_roc_points(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.1), (0, None), (None, 0.5)]
    got = [tuple(r) for r in E.roc_curve(frame(spark, rows)).orderBy("fpr", "tpr").collect()]
    # both later scores take one of each class: their point in the middle lies on a straight line
    assert got == [(float("inf"), 0.0, 0.0), (0.9, 0.0, pytest.approx(1 / 3)), (0.1, 1.0, 1.0)]


def test_roc_points_with_a_bend(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (0, 0.1), (1, 0.1)]
    got = [tuple(r) for r in E.roc_curve(frame(spark, rows)).orderBy("fpr", "tpr").collect()]
    thirds = [pytest.approx(k / 3) for k in range(4)]
    assert got == [(float("inf"), 0.0, 0.0), (0.9, 0.0, thirds[1]), (0.8, thirds[1], thirds[2]), (0.1, 1.0, 1.0)]


def test_straight_lines_go_on_across_slices(spark):
    """One row of each class at every score but one: only the ends and the bend stay, wherever slices end."""
    rows = [(y, k / 1000) for k in range(1000) for y in (0, 1)] + [(1, 0.5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        assert E._by_score(df).rows.select("_slice").distinct().count() > 1
        got = sorted((r.fpr, r.tpr, r.threshold) for r in E.roc_curve(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p[2] for p in got] == [float("inf"), 0.999, 0.501, 0.5, 0.0]


def test_threshold_is_inclusive(spark):
    got = E.predict_class(frame(spark, [(0, 0.35), (0, 0.3499)])).orderBy("churn_probability").collect()
    assert [r.prediction for r in got] == [0, 1]


def test_report(spark):
    # 3 true negatives, 1 false positive, 2 false negatives, 4 true positives
    rows = [(0, 0.1)] * 3 + [(0, 0.9)] + [(1, 0.1)] * 2 + [(1, 0.9)] * 4
    got = {r.class_name: tuple(r)[1:] for r in E.classification_report(E.predict_class(frame(spark, rows))).collect()}
    assert list(got) == ["Retained", "Churned", "accuracy", "macro avg", "weighted avg"]
    assert got["Retained"] == pytest.approx((0.6, 0.75, 2 / 3, 4))
    assert got["Churned"] == pytest.approx((0.8, 2 / 3, 8 / 11, 6))
    assert got["accuracy"] == pytest.approx((0.7, 0.7, 0.7, 10))
    assert got["macro avg"] == pytest.approx((0.7, (0.75 + 2 / 3) / 2, (2 / 3 + 8 / 11) / 2, 10))
    assert got["weighted avg"][0] == pytest.approx(0.6 * 0.4 + 0.8 * 0.6)


def test_report_without_predicted_churn_has_zeros(spark):
    got = {r.class_name: tuple(r)[1:] for r in E.classification_report(
        E.predict_class(frame(spark, [(0, 0.1), (1, 0.2)]))).collect()}
    assert got["Churned"] == (0.0, 0.0, 0.0, 1)


def test_weights_balance_the_classes(spark):
    got = {r.label: (r.n, r.weight) for r in E.class_weights(frame(spark, [(0, 0.0)] * 9 + [(1, 0.0)])).collect()}
    assert got == {0: (9, pytest.approx(10 / 18)), 1: (1, 5.0)}
