"""Every operator as a query over a folder of star schema tables.

Queries round means of fractional values to six decimals, because their last bits depend on the
order in which tasks finish; counts, sums and ratios of whole numbers are left as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.learning import churn_model, evaluation, imputation, split
from stayline.operators import actions, distributions, segments, summaries
from stayline.plans import kpis, reports
from stayline.plans.master import build_master
from stayline.session import durable
from stayline.sources.star_schema import VIEWS, business_tables
from stayline.sources.tables import table_profile
from workload import checks

AS_OF = date(1997, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _as(df: DataFrame, kind: str, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name in names})


def master(spark: SparkSession, folder: str) -> DataFrame:
    return build_master(business_tables(spark, folder), AS_OF)


def derived(spark: SparkSession, folder: str) -> DataFrame:
    return segments.derive_features(master(spark, folder))


def stand_in_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with a probability computed from the account id, so both engines know it; it has ties."""
    return (
        master(spark, folder)
        .withColumn("churn_probability", F.col("account_id") * 7919 % 1000 / 1000.0)
        .withColumn("label", F.col("churn_flag").cast("int"))
    )


def prioritised(spark: SparkSession, folder: str) -> DataFrame:
    return actions.add_priority(segments.value_segment(stand_in_scores(spark, folder)))


def _report(build: Callable[..., DataFrame], *names: str, doubles: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _as(build(*[VIEWS[n](spark, folder) for n in names]), "double", *doubles)

    return run


def _master_table(spark: SparkSession, folder: str) -> DataFrame:
    return _as(master(spark, folder), "double", "refund_usd")


def _kpis(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        kpis.kpis(master(spark, folder)),
        "avg_mrr", "avg_arr", "avg_resolution_hrs", "avg_first_response_mins", "avg_satisfaction",
    )


def _kpi_text(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.kpi_text(kpis.kpis(master(spark, folder)))


def _churn_rate(dimension: str) -> Query:
    return lambda spark, folder: kpis.churn_rate_by(master(spark, folder), dimension)


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(distributions.histogram(master(spark, folder)), "bin_left", "bin_right")


def _box(column: str) -> Query:
    return lambda spark, folder: _rounded(
        distributions.box_stats(master(spark, folder), column),
        "whisker_low", "q1", "median", "q3", "whisker_high",
    )


def _outliers(column: str) -> Query:
    return lambda spark, folder: _rounded(
        distributions.box_outliers(master(spark, folder), column), "value"
    )


def _derived_features(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder).select("account_id", *segments.FLAG_COLUMNS, *segments.DERIVED_COLUMNS)


def _segment(add: Callable[[DataFrame], DataFrame], name: str) -> Query:
    return lambda spark, folder: add(master(spark, folder)).select("account_id", name)


def _segment_counts(add: Callable[[DataFrame], DataFrame], name: str) -> Query:
    return lambda spark, folder: segments.segment_counts(add(master(spark, folder)), name)


def _retention_priority(spark: SparkSession, folder: str) -> DataFrame:
    return prioritised(spark, folder).select(
        "account_id", "value_segment", "churn_probability", "retention_priority"
    )


def _impact(spark: SparkSession, folder: str) -> DataFrame:
    return actions.business_impact(prioritised(spark, folder))


def _retention_actions(spark: SparkSession, folder: str) -> DataFrame:
    return actions.top_accounts(prioritised(spark, folder))


def _classification_report(spark: SparkSession, folder: str) -> DataFrame:
    predicted = evaluation.predict_class(stand_in_scores(spark, folder))
    return _rounded(evaluation.classification_report(predicted), "precision", "recall", "f1_score")


def _roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.roc_curve(stand_in_scores(spark, folder))


def _roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.roc_auc(stand_in_scores(spark, folder)), "roc_auc")


def _class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.class_weights(stand_in_scores(spark, folder))


def _split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes counted on the rows that were really drawn."""
    drawn = split.stratified_split(churn_model.labelled(derived(spark, folder)), "account_id")
    return drawn.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("is_test")).alias("train"),
        F.count_if("is_test").alias("test"),
    )


def _medians(spark: SparkSession, folder: str) -> DataFrame:
    df = durable(derived(spark, folder), "features")
    return _rounded(imputation.medians(df, churn_model.numeric_features(df)), "median")


def _modes(spark: SparkSession, folder: str) -> DataFrame:
    df = derived(spark, folder)
    return imputation.modes(df, churn_model.categorical_features(df))


def _trained(spark: SparkSession, folder: str) -> tuple[DataFrame, churn_model.Comparison]:
    """Stored features and the model comparison, trained anew for each query."""
    features = durable(derived(spark, folder), "features")
    return features, churn_model.compare_models(features)


def _model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return _trained(spark, folder)[1].summary


def _held_out_roc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.roc_curve(_trained(spark, folder)[1].held_out)


def scored_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every account scored by the best model, with segments and priority."""
    features, comparison = _trained(spark, folder)
    scored = churn_model.score_accounts(features, churn_model.refit(features, comparison.best))
    return actions.add_priority(segments.add_segments(scored))


def _feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Of the better forest, whichever learner is best of all."""
    features, comparison = _trained(spark, folder)
    forest = max((churn_model.FOREST, churn_model.EXTRA_TREES), key=comparison.aucs.get)
    return churn_model.feature_importance(spark, churn_model.refit(features, forest))


def _model_actions(spark: SparkSession, folder: str) -> DataFrame:
    """The action list on the best model's own probabilities."""
    return actions.top_accounts(scored_accounts(spark, folder))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return table_profile(business_tables(spark, folder))


def queries() -> dict[str, Query]:
    one_table = {
        "support_summary": (summaries.support_summary, ("support_tickets",), ()),
        "usage_summary": (summaries.usage_summary, ("feature_usage", "subscriptions"), ()),
        "churn_summary": (summaries.churn_summary, ("churn_events",), ("refund_usd",)),
        "latest_subscription": (summaries.latest_subscription, ("subscriptions",), ()),
        "report_churn_by_plan": (reports.churn_by_plan, ("accounts",), ()),
        "report_churn_by_industry": (reports.churn_by_industry, ("accounts",), ()),
        "report_revenue_at_risk": (reports.revenue_at_risk, ("accounts", "subscriptions"), ()),
        "report_sla_breaches": (reports.sla_breaches, ("support_tickets",), ()),
        "report_feature_errors": (reports.feature_errors, ("feature_usage",), ()),
        "report_churn_reasons": (reports.churn_reasons, ("churn_events",), ()),
        "report_top_customers": (reports.top_customers, ("accounts", "subscriptions"), ()),
        "report_signup_cohorts": (reports.signup_cohorts, ("accounts",), ()),
        "churn_reason_counts": (kpis.churn_reason_counts, ("churn_events",), ()),
    }
    return {
        **{key: _report(build, *names, doubles=doubles) for key, (build, names, doubles) in one_table.items()},
        "master_table": _master_table,
        "table_profile": _profile,
        "kpis": _kpis,
        "kpi_text": _kpi_text,
        "churn_rate_by_plan": _churn_rate("sub_plan_tier"),
        "churn_rate_by_industry": _churn_rate("industry"),
        "churn_rate_by_referral": _churn_rate("referral_source"),
        "churn_rate_by_billing": _churn_rate("billing_frequency"),
        "mrr_histogram": _histogram,
        "box_satisfaction": _box("avg_satisfaction"),
        "box_usage_events": _box("total_usage_events"),
        "box_resolution": _box("avg_resolution_hrs"),
        "box_errors": _box("total_errors"),
        "outliers_satisfaction": _outliers("avg_satisfaction"),
        "outliers_usage_events": _outliers("total_usage_events"),
        "outliers_resolution": _outliers("avg_resolution_hrs"),
        "outliers_errors": _outliers("total_errors"),
        "derived_features": _derived_features,
        "value_segment": _segment(segments.value_segment, "value_segment"),
        "tenure_segment": _segment(segments.tenure_segment, "tenure_segment"),
        "engagement_segment": _segment(segments.engagement_segment, "engagement_segment"),
        "value_segment_counts": _segment_counts(segments.value_segment, "value_segment"),
        "tenure_segment_counts": _segment_counts(segments.tenure_segment, "tenure_segment"),
        "retention_priority": _retention_priority,
        "priority_counts": lambda s, d: actions.priority_counts(prioritised(s, d)),
        "priority_mean_probability": lambda s, d: _rounded(
            actions.priority_mean_probability(prioritised(s, d)), "mean_probability"
        ),
        "priority_mrr": lambda s, d: actions.priority_mrr(prioritised(s, d)),
        "business_impact": _impact,
        "business_impact_text": lambda s, d: actions.impact_text(_impact(s, d)),
        "retention_actions": _retention_actions,
        "class_weights": _class_weights,
        "roc_auc": _roc_auc,
        "roc_curve": _roc_curve,
        "classification_report": _classification_report,
        "stratified_split_sizes": _split_sizes,
        "impute_median": _medians,
        "impute_mode": _modes,
        **checks.queries(),
        "model_comparison": _model_comparison,
        "held_out_roc_curve": _held_out_roc,
        "scored_accounts": scored_accounts,
        "feature_importance": _feature_importance,
        "model_retention_actions": _model_actions,
    }
