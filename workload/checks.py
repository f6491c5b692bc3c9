"""Queries that check reading, writing, encoding and the handling of faulty data."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.learning import churn_model, evaluation, logistic, split
from stayline.operators import actions, segments
from stayline.plans import kpis
from stayline.plans.master import build_master
from stayline.session import durable, shared_folder, small_table
from stayline.sources import sinks
from stayline.sources.star_schema import business_tables
from stayline.sources.tables import load_tables, preview, read_parquet_table

AS_OF = date(1997, 1, 1)
DATABASE = "stayline_checks"
MEANS = ("avg_resolution_hrs", "avg_first_response_mins", "avg_satisfaction", "avg_duration_secs")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/checks/{name}-{uuid.uuid4().hex}"


def _as_views(found: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """A master table with the column types that the views give, refunds as doubles and means rounded."""
    kinds = dict(build_master(business_tables(spark, folder), AS_OF).dtypes) | {"refund_usd": "double"}
    df = found.select([F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return df.withColumns({c: F.round(c, 6) for c in MEANS})


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The master table of tables that were written as CSV and read by name.

    Ids are text there, so those that decide ties are written with leading zeros to keep their order.
    """
    path = _new_folder(spark, "csv")
    for name, df in business_tables(spark, folder).items():
        ids = [c for c in ("subscription_id", "churn_event_id") if c in df.columns]
        df = df.withColumns({c: F.lpad(F.col(c).cast("string"), 19, "0") for c in ids})
        df.write.option("header", True).csv(f"{path}/t_{name}.csv")
    return _as_views(build_master(load_tables(spark, path, "csv", "t_"), AS_OF), spark, folder)


def catalog_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The master table of catalog tables, written and read again."""
    prefix = f"t{uuid.uuid4().hex}_"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    tables = business_tables(spark, folder)
    for name, df in tables.items():
        df.write.saveAsTable(f"{DATABASE}.{prefix}{name}")
    path = _new_folder(spark, "master")
    sinks.write_master(build_master(load_tables(spark, DATABASE, "catalog", prefix), AS_OF), path)
    for name in tables:
        spark.sql(f"DROP TABLE {DATABASE}.{prefix}{name}")
    return _as_views(read_parquet_table(spark, path), spark, folder)


def _prioritised(spark: SparkSession, folder: str) -> DataFrame:
    from workload.queries import prioritised

    return prioritised(spark, folder)


def scored_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _new_folder(spark, "scored")
    sinks.write_scored(_prioritised(spark, folder), path)
    return spark.read.parquet(sinks.current(spark, path)).select("account_id", "churn_probability", "retention_priority", "priority_class")


def actions_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _new_folder(spark, "actions")
    top = actions.top_accounts(_prioritised(spark, folder))
    sinks.write_actions(top, path)
    return spark.read.schema(top.schema).option("header", True).csv(sinks.current(spark, path))


def master_preview(spark: SparkSession, folder: str) -> DataFrame:
    master = build_master(business_tables(spark, folder), AS_OF)
    return preview(master, 3, "account_id").withColumn("refund_usd", F.col("refund_usd").cast("double"))


def dirty_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The business tables with missing flags, reasons and keys, infinite seats, text among numbers, cents, half points,
    and without two columns."""
    tables = business_tables(spark, folder)
    return tables | {
        "accounts": tables["accounts"].drop("referral_source").withColumns({
            "industry": F.expr("if(account_id % 11 <> 0, industry, null)"),
            "seats": F.expr("if(account_id % 19 = 0, double('Infinity'), cast(seats as double))"),
            "churn_flag": F.expr("if(account_id % 5 <> 0, churn_flag, null)"),
        }),
        "subscriptions": tables["subscriptions"].drop("billing_frequency").withColumns({
            "account_id": F.expr("if(subscription_id % 13 <> 0, account_id, null)"),
            "mrr_amount": F.expr("cast(mrr_amount + 0.25 as decimal(18,2))"),
            "arr_amount": F.expr("if(subscription_id % 17 = 0, 'n/a', cast(arr_amount as string))"),
        }),
        "support_tickets": tables["support_tickets"].withColumn(
            "satisfaction_score", F.expr("if(ticket_id % 3 = 0, satisfaction_score + 0.5D, cast(satisfaction_score as double))")
        ),
        "churn_events": tables["churn_events"].withColumn("reason_code", F.expr("if(churn_event_id % 4 <> 0, reason_code, null)")),
    }


def dirty_master(spark: SparkSession, folder: str) -> DataFrame:
    df = segments.derive_features(build_master(dirty_tables(spark, folder), AS_OF))
    return df.select(
        "account_id", "industry", "churn_flag", "churn_label", "seats", F.col("mrr_amount").cast("double").alias("mrr_amount"), "arr_amount",
        F.round("avg_satisfaction", 6).alias("avg_satisfaction"), "churn_reason", F.round("revenue_per_seat", 6).alias("revenue_per_seat"),
    )


def dirty_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.churn_reason_counts(dirty_tables(spark, folder)["churn_events"])


def dirty_churn_rate(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.churn_rate_by(build_master(dirty_tables(spark, folder), AS_OF), "industry")


def _derived(spark: SparkSession, folder: str) -> DataFrame:
    return durable(segments.derive_features(build_master(business_tables(spark, folder), AS_OF)), "features")


def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Which accounts are held out."""
    drawn = split.stratified_split(churn_model.labelled(_derived(spark, folder)), "account_id")
    return drawn.select("account_id", "label", "is_test")


def encoded_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every slot of every account's feature vector, by name."""
    rows = churn_model.labelled(_derived(spark, folder))
    ready = churn_model.fit_features(rows).apply(rows, ["account_id"])
    names = F.array(*[F.lit(name) for name in churn_model.feature_names(ready)])
    pairs = F.explode(F.arrays_zip(names.alias("slot"), vector_to_array("features").alias("value")))
    return ready.select("account_id", pairs.alias("pair")).select("account_id", "pair.slot", F.round("pair.value", 6).alias("value"))


def model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold whatever the models find: (subject, check_name, value).

    Held-out rows of each learner, the best one's area computed in two ways, probabilities in range, every account scored once with the priority of
    its own probability, importances that add up and descend.
    """
    features = _derived(spark, folder)
    comparison = churn_model.compare_models(features)
    held_out = evaluation.roc_auc(comparison.held_out).first()["roc_auc"]
    p = F.col("churn_probability")
    outside = F.count_if(~p.between(0, 1) | p.isNull())
    rows = [(r["model"], "held_out_rows", float(r["support"])) for r in comparison.summary.filter("class_name = 'accuracy'").collect()]
    rows += [
        ("best", "area_differs", round(abs(comparison.aucs[comparison.best] - held_out), 6)),
        ("best", "is_not_largest", float(comparison.aucs[comparison.best] < max(comparison.aucs.values()))),
        ("best", "outside_0_1", float(comparison.held_out.agg(outside).first()[0])),
    ]
    forest = max((churn_model.FOREST, churn_model.EXTRA_TREES), key=comparison.aucs.get)
    final = churn_model.refit(features, forest)
    scored = durable(actions.add_priority(segments.add_segments(churn_model.score_accounts(features, final))), "scored")
    risk = F.when((F.col("value_segment") == "High Value") & (p >= 0.60), "P1").when(
        (F.col("value_segment") == "Mid Value") & (p >= 0.50), "P2"
    ).when(p >= 0.40, "P3").otherwise("P4")
    found = scored.agg(
        F.count(F.lit(1)).alias("accounts"), F.count_distinct("account_id").alias("distinct_accounts"), outside.alias("outside_0_1"),
        F.count_if(F.substring("retention_priority", 1, 2) != risk).alias("priority_differs"),
    ).first()
    rows += [("scored", name, float(found[name])) for name in ("accounts", "distinct_accounts", "outside_0_1", "priority_differs")]
    every = [r["importance"] for r in churn_model.feature_importance(spark, final, None).collect()]
    top = [r["importance"] for r in churn_model.feature_importance(spark, final).collect()]
    rows += [
        ("importance", "sum", round(sum(every), 6)),
        ("importance", "top", float(len(top))),
        ("importance", "top_differs", float(top != sorted(every, reverse=True)[:15])),
    ]
    return small_table(spark, rows, "subject string, check_name string, value double")


def logistic_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """The logistic learner on two features, classes balanced, every account with both: (slot, weight), the constant penalised too."""
    slots = ("seats", "ticket_count")
    rows = churn_model.labelled(_derived(spark, folder)).dropna(subset=list(slots))
    weights = evaluation.class_weights(rows).select("label", "weight")
    cells = F.array(*[F.col(c).cast("double") for c in slots]).alias("cells")
    ready = durable(rows.join(F.broadcast(weights), "label").select("label", "weight", cells), "logistic")
    found = logistic.fit(ready, len(slots)).weights
    named = [(name, round(float(w), 6)) for name, w in zip((*slots, "constant"), found)]
    return small_table(spark, named, "slot string, weight double")


def out_of_fold_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each fold: accounts, accounts trained on, accounts in both, and accounts without a probability from 0 to 1."""
    features, folds = _derived(spark, folder), 5
    scored = durable(churn_model.score_out_of_fold(features, churn_model.LOGISTIC, folds=folds), "out-of-fold")
    p = F.col("churn_probability")
    by_fold = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if(p.isNull() | ~p.between(0, 1)).alias("outside_0_1")
    )
    trained = None
    for k, (own, others) in enumerate(churn_model.fold_parts(features.select("account_id", "churn_flag"), "account_id", folds)):
        seen = churn_model.labelled(others).select("account_id", F.lit(1).alias("seen"))
        held = own.select("account_id", F.lit(1).alias("held"))
        row = seen.join(held, "account_id", "full").agg(
            F.lit(k).alias("fold"), F.count("seen").alias("trained_on"), F.count_if(F.col("seen").isNotNull() & F.col("held").isNotNull()).alias("in_both")
        )
        trained = row if trained is None else trained.unionByName(row)
    return by_fold.join(trained, "fold")


CHECKS = (
    csv_round_trip, catalog_round_trip, scored_round_trip, actions_round_trip, master_preview, dirty_master,
    dirty_reason_counts, dirty_churn_rate, split_rows, encoded_features, model_checks,
    logistic_coefficients, out_of_fold_checks,
)


def queries() -> dict:
    return {check.__name__: check for check in CHECKS}
