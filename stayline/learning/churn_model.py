"""Training, comparing and applying the churn models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.columns import present
from stayline.learning import logistic, trees
from stayline.learning.evaluation import class_weights, classification_report, predict_class, roc_auc
from stayline.learning.imputation import medians, modes
from stayline.learning.split import SEED, stratified_split
from stayline.operators.segments import DERIVED_COLUMNS, FLAG_COLUMNS, NUMERIC_COLUMNS
from stayline.session import durable, small_table

# The categorical features.
CATEGORICAL_COLUMNS = ("industry", "country", "referral_source", "sub_plan_tier", "billing_frequency")

LOGISTIC, FOREST, EXTRA_TREES = "logistic_regression", "random_forest", "extra_trees"

Model = logistic.Fitted | trees.Ensemble


@dataclass(frozen=True)
class ModelSettings:
    """Fixed values of the three learners; tests pass fewer trees."""

    max_iter: int = 3000
    tolerance: float = 1e-9
    penalty_c: float = 1.0
    forest_trees: int = 500
    extra_trees: int = 600
    max_depth: int = 10
    min_leaf: int = 3
    seed: int = SEED


@dataclass(frozen=True)
class Features:
    """Fitted preprocessing: replacement values and the encoder."""

    fill: dict[str, object]
    numeric: list[str]
    categorical: list[str]
    encoder: PipelineModel

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return self.encoder.transform(_filled(df, self.fill, self.numeric, self.categorical, keep)).select(
            *keep, "features"
        )


@dataclass(frozen=True)
class Comparison:
    """The three fitted models with their quality on the held-out rows."""

    summary: DataFrame
    best: str
    aucs: dict[str, float]
    held_out: DataFrame = field(repr=False)


def labelled(features: DataFrame) -> DataFrame:
    """Add the 0/1 ``label``; rows without a known outcome are left out of training."""
    if "churn_flag" not in features.columns:
        raise ValueError("Target column 'churn_flag' not found in master table.")
    return features.filter(F.col("churn_flag").isNotNull()).withColumn("label", F.col("churn_flag").cast("int"))


def numeric_features(df: DataFrame) -> list[str]:
    return present(df, (*NUMERIC_COLUMNS, *DERIVED_COLUMNS, *FLAG_COLUMNS))


def categorical_features(df: DataFrame) -> list[str]:
    return present(df, CATEGORICAL_COLUMNS)


def _filled(
    df: DataFrame, fill: dict[str, object], numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    return df.select(
        *keep,
        *[F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias(f"num__{c}") for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit(fill[c])).alias(f"text__{c}") for c in categorical],
    )


def fit_features(train: DataFrame) -> Features:
    """Medians, most frequent values and category codes of the training rows.

    A column without a single value has no replacement and is dropped. Categories unseen here
    become all zeros when the encoder is applied.
    """
    numeric, categorical = numeric_features(train), categorical_features(train)
    # one row per feature
    fill: dict[str, object] = {}
    if numeric:
        fill.update({r["feature"]: r["median"] for r in medians(train, numeric).collect()})
    if categorical:
        fill.update({r["feature"]: r["mode"] for r in modes(train, categorical).collect()})
    numeric = [c for c in numeric if c in fill]
    categorical = [c for c in categorical if c in fill]
    filled = _filled(train, fill, numeric, categorical, [])
    stages = []
    if categorical:
        codes = [f"code_{c}" for c in categorical]
        stages = [
            # the extra slot for unseen values is the one the encoder drops
            StringIndexer(inputCols=[f"text__{c}" for c in categorical], outputCols=codes, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=codes, outputCols=[f"cat__{c}" for c in categorical], dropLast=True),
        ]
    stages.append(
        VectorAssembler(
            inputCols=[*[f"num__{c}" for c in numeric], *[f"cat__{c}" for c in categorical]], outputCol="features"
        )
    )
    return Features(fill, numeric, categorical, Pipeline(stages=stages).fit(filled))


def learners(settings: ModelSettings) -> dict[str, Callable[[DataFrame, int], Model]]:
    """The learners in the order in which they win ties; each takes prepared rows and the number of features.

    Forests balance the classes by each tree's own draws, extra trees by the rows, logistic regression by row weights.
    """
    shape = {"max_depth": settings.max_depth, "min_leaf": settings.min_leaf, "seed": settings.seed}
    return {
        LOGISTIC: lambda rows, n: logistic.fit(rows, n, settings.penalty_c, settings.max_iter, settings.tolerance),
        FOREST: lambda rows, n: trees.grow(rows, n, trees.forest(settings.forest_trees, **shape)),
        EXTRA_TREES: lambda rows, n: trees.grow(rows, n, trees.extra_trees(settings.extra_trees, **shape)),
    }


def _prepared(rows: DataFrame, features: Features, keep: Sequence[str], name: str) -> DataFrame:
    """Stored training rows (row_hash, label, cells, weight), dealt by a hash of their key."""
    classes = class_weights(rows).collect()  # one row for each class
    weight = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(r["weight"])) for r in classes], F.lit(0.0)).alias("weight")
    ready = features.apply(rows, [*keep, "label"])
    n = sum(r["n"] for r in classes)
    return durable(trees.training_rows(ready, n, F.struct(*keep), F.col("label"), vector_to_array("features"), weight), name)


def score(model: Model, prepared: DataFrame) -> DataFrame:
    """Add ``churn_probability``: a narrow pass, the model is sent along."""
    predicted = logistic.predicted if isinstance(model, logistic.Fitted) else trees.predicted
    return predicted(model, prepared, vector_to_array("features"), "churn_probability")


def compare_models(features: DataFrame, key: str = "account_id", settings: ModelSettings = ModelSettings()) -> Comparison:
    """Fit every learner on the training rows and judge it on the held-out ones.

    ``features`` is read several times, so store it first. The highest AUC wins, the earlier learner on a tie. ``summary`` has one row per learner and
    ``held_out`` the best learner's probabilities.
    """
    rows = durable(stratified_split(labelled(features), key), "split")
    train, test = rows.filter(~F.col("is_test")), rows.filter(F.col("is_test"))
    fitted = fit_features(train)
    test_rows = fitted.apply(test, [key, "label"])
    n = len(feature_names(test_rows))
    train_rows, test_rows = _prepared(train, fitted, [key], "train"), durable(test_rows, "test")
    aucs: dict[str, float] = {}
    scores: dict[str, DataFrame] = {}
    reports: list[tuple] = []
    for name, learn in learners(settings).items():
        scored = score(learn(train_rows, n), test_rows)
        scores[name] = durable(scored.select(key, "label", "churn_probability"), "held-out")
        aucs[name] = roc_auc(scores[name]).first()["roc_auc"]
        for line in classification_report(predict_class(scores[name])).collect():  # five rows
            reports.append((name, aucs[name], *line))
    # an area is unknown where a class has no held-out row
    best = max(aucs, key=lambda name: -1.0 if aucs[name] is None else aucs[name])
    summary = small_table(
        features.sparkSession,
        reports,
        "model string, roc_auc double, class_name string, precision double, recall double, f1_score double, support bigint",
    ).withColumn("is_best", F.col("model") == best)
    return Comparison(summary, best, aucs, scores[best])


@dataclass(frozen=True)
class FinalModel:
    """A learner refitted on every labelled account."""

    name: str
    model: Model
    features: Features
    names: list[str]


def refit(features: DataFrame, name: str, key: str = "account_id", settings: ModelSettings = ModelSettings()) -> FinalModel:
    """Fit the learner on all labelled rows. ``features`` is read several times, so store it first."""
    rows = labelled(features)
    fitted = fit_features(rows)
    names = feature_names(fitted.apply(rows, []))
    return FinalModel(name, learners(settings)[name](_prepared(rows, fitted, [key], "all"), len(names)), fitted, names)


def score_accounts(features: DataFrame, final: FinalModel, key: str = "account_id") -> DataFrame:
    """Add ``churn_probability`` to every account: a narrow pass, with no join back.

    The model has seen these accounts, so the scores are optimistic; ``score_out_of_fold`` gives others.
    """
    ready = final.features.encoder.transform(
        _filled(features, final.features.fill, final.features.numeric, final.features.categorical, features.columns)
    )
    return score(final.model, ready).select(*features.columns, "churn_probability")


def fold_of(key: Column, folds: int, seed: int = SEED) -> Column:
    """The fold of an account, from a seeded hash of its key; a missing key has fold 0."""
    digits = F.substring(F.md5(F.concat(F.lit(f"fold {seed}:"), key.cast("string"))), 1, 15)
    return F.coalesce(F.conv(digits, 16, 10).cast("long") % folds, F.lit(0)).cast("int")


def fold_parts(features: DataFrame, key: str, folds: int, seed: int = SEED) -> list[tuple[DataFrame, DataFrame]]:
    """For each fold its accounts and those of all other folds: filters on stored rows with a ``fold`` column."""
    dealt = durable(features.withColumn("fold", fold_of(F.col(key), folds, seed)), "folds")
    return [(dealt.filter(F.col("fold") == k), dealt.filter(F.col("fold") != k)) for k in range(folds)]


def score_out_of_fold(
    features: DataFrame, name: str, key: str = "account_id", folds: int = 5, settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """Add ``fold`` and ``churn_probability``, that of a model which has learnt from the other folds alone.

    Every account is scored, labelled or not, and accounts that repeat a key share a fold. The parts are put together again
    without a join; replacement values and category codes are those of the other folds too.
    """
    parts = fold_parts(features, key, folds, settings.seed)
    return reduce(DataFrame.unionByName, [score_accounts(own, refit(others, name, key, settings)) for own, others in parts])


def feature_names(prepared: DataFrame) -> list[str]:
    """Names of the vector slots, in order."""
    groups = prepared.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])
    return [slot["name"] for slot in slots]


def feature_importance(spark: SparkSession, final: FinalModel, n: int | None = 15) -> DataFrame:
    """The most important features of an ensemble of trees, largest first; no rows for other learners."""
    schema = "feature string, importance double"
    if not isinstance(final.model, trees.Ensemble):
        return small_table(spark, [], schema)
    named = zip(final.names, final.model.importance.tolist())
    ranked = small_table(spark, list(named), schema).orderBy(F.desc("importance"), "feature")
    return ranked if n is None else ranked.limit(n)
