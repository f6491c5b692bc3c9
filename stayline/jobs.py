"""The three batch jobs: explore, score and report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from stayline.learning.churn_model import (
    ModelSettings,
    compare_models,
    feature_importance,
    refit,
    score_accounts,
    score_out_of_fold,
)
from stayline.learning.evaluation import roc_curve
from stayline.operators.actions import (
    add_priority,
    business_impact,
    by_priority,
    impact_text,
    top_accounts,
)
from stayline.operators.distributions import box_parts, histogram
from stayline.operators.segments import add_segments, derive_features, segment_counts
from stayline.plans.kpis import churn_rate_by, churn_reason_counts, kpi_text, kpis
from stayline.plans.master import build_master
from stayline.plans.reports import all_reports
from stayline.session import durable, work_folder
from stayline.sources.sinks import write_actions, write_master, write_scored, write_small
from stayline.sources.tables import preview, read_parquet_table, table_profile

MASTER, SCORED, ACTIONS = "master_table", "master_with_predictions", "retention_actions"

# Names of the chart data sets and the columns they show.
RATE_CHARTS = {
    "01_churn_by_plan_tier": "sub_plan_tier",
    "02_churn_by_industry": "industry",
    "03_churn_by_referral_source": "referral_source",
    "09_churn_by_billing_frequency": "billing_frequency",
}

BOX_CHARTS = {
    "06_satisfaction_vs_churn": "avg_satisfaction",
    "07_usage_events_vs_churn": "total_usage_events",
    "08_resolution_time_vs_churn": "avg_resolution_hrs",
    "10_errors_vs_churn": "total_errors",
}


def explore(
    spark: SparkSession, tables: dict[str, DataFrame], output: str, as_of: date | None = None, work: str | None = None
) -> None:
    """Write the master table once, then the KPIs and chart data sets computed from it.

    A chart whose column is absent is left out. Intermediates lie below ``work`` (``output`` by default) while the job runs.
    """
    with work_folder(spark, work or output):
        _explore(spark, tables, output, as_of)


def _explore(spark: SparkSession, tables: dict[str, DataFrame], output: str, as_of: date | None) -> None:
    write_small(table_profile(tables), f"{output}/table_profile")
    write_master(build_master(tables, as_of), f"{output}/{MASTER}")
    master = read_parquet_table(spark, f"{output}/{MASTER}")
    write_small(preview(master, order_by="account_id"), f"{output}/master_preview")
    figures = durable(kpis(master), "kpis")
    write_small(figures, f"{output}/kpis")
    write_small(kpi_text(figures), f"{output}/kpi_text")
    for chart, dimension in RATE_CHARTS.items():
        if dimension in master.columns:
            write_small(churn_rate_by(master, dimension), f"{output}/{chart}")
    if "reason_code" in tables["churn_events"].columns:
        write_small(churn_reason_counts(tables["churn_events"]), f"{output}/04_churn_reasons")
    if "mrr_amount" in master.columns:
        write_small(histogram(master), f"{output}/05_mrr_distribution_churn")
    for chart, column in BOX_CHARTS.items():
        if column in master.columns:
            stats, outliers = box_parts(master, column)
            write_small(stats, f"{output}/{chart}")
            write_small(outliers, f"{output}/{chart}_outliers")


def score(
    spark: SparkSession, output: str, settings: ModelSettings = ModelSettings(), work: str | None = None, folds: int = 0
) -> None:
    """Train, choose, score every account of the stored master table and write what to do.

    With ``folds`` (2 or more) every account also gets the score of a model that has not learnt from it. Intermediates lie below ``work`` (``output`` by default) while the job runs.
    """
    master = read_parquet_table(spark, f"{output}/{MASTER}")
    with work_folder(spark, work or output):
        _score(spark, master, output, settings, folds)


def _score(spark: SparkSession, master: DataFrame, output: str, settings: ModelSettings, folds: int) -> None:
    features = durable(derive_features(master), "features")
    comparison = compare_models(features, settings=settings)
    write_small(comparison.summary, f"{output}/model_comparison")
    write_small(roc_curve(comparison.held_out), f"{output}/15_roc_curve")
    final = refit(features, comparison.best, settings=settings)
    write_small(feature_importance(spark, final), f"{output}/14_feature_importance")
    write_scored(add_priority(add_segments(score_accounts(features, final))), f"{output}/{SCORED}")

    if folds > 1:
        unseen = score_out_of_fold(features, comparison.best, folds=folds, settings=settings)
        write_small(unseen.select("account_id", "fold", "churn_probability"), f"{output}/out_of_fold_scores")

    scored = read_parquet_table(spark, f"{output}/{SCORED}")
    write_small(segment_counts(scored, "value_segment"), f"{output}/value_segment_counts")
    priorities = durable(by_priority(scored), "priorities")
    for chart, column in {
        "11_retention_priority_distribution": "accounts",
        "12_churn_probability_by_priority": "mean_probability",
        "13_revenue_by_priority": "mrr",
    }.items():
        write_small(priorities.select("retention_priority", column), f"{output}/{chart}")
    impact = durable(business_impact(scored), "impact")
    write_small(impact, f"{output}/business_impact")
    write_small(impact_text(impact), f"{output}/business_impact_text")
    write_actions(top_accounts(scored), f"{output}/{ACTIONS}")


def report(tables: dict[str, DataFrame], output: str) -> None:
    for name, df in all_reports(tables).items():
        write_small(df, f"{output}/report_{name}")
