import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.learning import churn_model as M
from stayline.learning.imputation import medians, modes
from stayline.learning.split import held_out_sizes, stratified_split
from stayline.session import durable
from workload.queries import derived

FEW = M.ModelSettings(max_iter=30, forest_trees=5, extra_trees=4, max_depth=3)


@pytest.fixture(scope="module")
def features(spark, folder):
    return durable(derived(spark, folder), "test-features")


@pytest.fixture(scope="module")
def comparison(features):
    return M.compare_models(features, settings=FEW)


@pytest.mark.parametrize("counts", [(80, 20), (7, 4), (10, 3), (1, 9), (390, 110)])
def test_held_out_sizes(spark, counts):
    rows = [(i, label) for label, n in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, label int").withColumn("key", F.concat_ws("-", "label", "id"))
    total = sum(counts)
    got = {r.label: r for r in held_out_sizes(df).collect()}
    assert sum(r.test for r in got.values()) == -(-total // 5)
    for label, n in enumerate(counts):
        assert abs(got[label].train - n * (total - -(-total // 5)) / total) < 1
    drawn = stratified_split(df, "key")
    assert drawn.count() == total
    assert {r.label: r.n for r in drawn.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {
        k: r.test for k, r in got.items() if r.test
    }


def test_split_is_repeatable_and_seeded(spark):
    df = spark.range(500).withColumn("label", (F.col("id") % 4 == 0).cast("int"))

    def held(seed, parts):
        return {r.id for r in stratified_split(df.repartition(parts), "id", seed).filter("is_test").collect()}

    assert held(42, 2) == held(42, 7) != held(43, 2)


def test_medians_and_modes(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None, "b"), (2, None, None, "a"), (4, 8.0, None, "a"), (9, 4.0, None, "b"), (None, 6.0, None, None)],
        "a int, b double, c double, d string",
    )
    assert {r.feature: r.median for r in medians(df, ["a", "b", "c"]).collect()} == {"a": 3.0, "b": 5.0}
    assert {r.feature: r["mode"] for r in modes(df, ["d"]).collect()} == {"d": "a"}


def test_missing_target(spark):
    with pytest.raises(ValueError, match="churn_flag"):
        M.labelled(spark.range(1))


def test_unseen_category_is_all_zeros_and_empty_feature_is_dropped(spark):
    schema = "seats int, ticket_count int, industry string, country string"
    train = spark.createDataFrame([(1, None, "x", None), (3, None, "y", None), (None, None, "x", None)], schema)
    fitted = M.fit_features(train)
    assert (fitted.numeric, fitted.categorical) == (["seats"], ["industry"])
    test = spark.createDataFrame([(None, 5, "z", "q"), (7, 5, None, "q"), (7, 5, "y", "q")], schema).coalesce(1)
    got = [list(r.features.toArray()) for r in fitted.apply(test, []).collect()]
    assert got == [[2.0, 0.0, 0.0], [7.0, 1.0, 0.0], [7.0, 0.0, 1.0]]


def test_comparison(comparison):
    assert list(comparison.aucs) == [M.LOGISTIC, M.FOREST, M.EXTRA_TREES]
    assert comparison.aucs[comparison.best] == max(comparison.aucs.values())
    summary = comparison.summary.collect()
    assert len(summary) == 15 and {r.model for r in summary if r.is_best} == {comparison.best}
    assert all(0 <= r.churn_probability <= 1 for r in comparison.held_out.collect())


def test_same_seed_same_forest(features):
    one, two = (M.refit(features, M.FOREST, settings=FEW).model.importance for _ in range(2))
    assert np.allclose(one, two)


@pytest.mark.parametrize("name", [M.FOREST, M.EXTRA_TREES, M.LOGISTIC])
def test_training_does_not_depend_on_files(spark, features, tmp_path, name):
    found = []
    for files, parallel in ((1, "1"), (9, "5")):
        path = f"{tmp_path}/{files}"
        features.repartition(files).write.parquet(path)
        spark.conf.set("spark.sql.files.minPartitionNum", parallel)
        try:
            final = M.refit(spark.read.parquet(path), name, settings=FEW)
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
        scored = M.score_accounts(features, final).select("account_id", "churn_probability")
        found.append({r.account_id: r.churn_probability for r in scored.collect()})
    assert found[0].keys() == found[1].keys()
    assert np.allclose([found[0][k] for k in found[0]], [found[1][k] for k in found[0]], rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", [M.LOGISTIC, M.FOREST, M.EXTRA_TREES])
def test_every_account_is_scored_once(spark, features, name):
    final = M.refit(features, name, settings=FEW)
    scored = M.score_accounts(features, final)
    assert scored.columns == [*features.columns, "churn_probability"]
    assert scored.count() == features.count() == scored.select("account_id").distinct().count()
    assert scored.filter("churn_probability between 0 and 1").count() == features.count()
    importance = M.feature_importance(spark, final).collect()
    if name == M.LOGISTIC:
        assert importance == []
    else:
        values = [r.importance for r in importance]
        assert len(values) == 15 and values == sorted(values, reverse=True)
        everything = M.feature_importance(spark, final, None).collect()
        assert sum(r.importance for r in everything) == pytest.approx(1.0)
        names = {r.feature for r in everything}
        assert "num__tenure_days" in names and any(n.startswith("cat__industry_") for n in names)


def test_the_models_find_a_planted_signal(spark):
    r = random.Random(1)
    rows = [(f"{i:04d}", t := r.randrange(100), r.randrange(9), t + r.randrange(-20, 20) > 60) for i in range(600)]
    df = spark.createDataFrame(rows, "account_id string, ticket_count int, seats int, churn_flag boolean")
    found = M.compare_models(df, settings=M.ModelSettings(max_iter=30, forest_trees=5, extra_trees=4, max_depth=5))
    assert min(found.aucs.values()) > 0.9


def test_folds_are_not_stored_wide_again(spark, monkeypatch):
    rows = [(i, i % 7, i % 5, i % 3 == 0 if i % 10 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "account_id long, ticket_count int, seats int, churn_flag boolean")
    stored = []

    def noted(table, name):
        stored.append((name, len(table.columns)))
        return durable(table, name)

    monkeypatch.setattr(M, "durable", noted)
    scored = M.score_out_of_fold(df, M.LOGISTIC, folds=3, settings=FEW)
    assert scored.count() == 120 and scored.filter("churn_probability between 0 and 1").count() == 120
    # once all accounts, and of each fold only what its learner reads
    assert stored == [("folds", 5)] + 3 * [("all", 4)]
