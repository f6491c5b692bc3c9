import datetime

import pytest

from stayline import jobs
from stayline.learning.churn_model import ModelSettings
from stayline.operators.actions import ACTION_COLUMNS
from stayline.sources.sinks import current
from stayline.sources.star_schema import business_tables
from stayline.sources.tables import MissingInput

FEW = ModelSettings(max_iter=20, forest_trees=4, extra_trees=4, max_depth=3)


def test_score_needs_the_master_table(spark, tmp_path):
    with pytest.raises(MissingInput, match="master_table"):
        jobs.score(spark, str(tmp_path))


def test_all_jobs_end_to_end(spark, folder, tmp_path):
    out = str(tmp_path)
    tables = business_tables(spark, folder)
    jobs.explore(spark, tables, out, datetime.date(1997, 1, 1))
    jobs.report(tables, out)
    jobs.score(spark, out, FEW)

    assert not list(tmp_path.glob("_work*"))
    n = tables["accounts"].count()
    master = spark.read.parquet(current(spark, f"{out}/master_table"))
    scored = spark.read.parquet(current(spark, f"{out}/master_with_predictions"))
    assert (master.count(), len(master.columns)) == (n, 36)
    assert (scored.count(), len(scored.columns)) == (n, 50)  # 49 and the partition column
    assert {p.name for p in tmp_path.glob("report_*")} == {
        f"report_{r}" for r in ("churn_by_plan", "churn_by_industry", "revenue_at_risk", "sla_breaches",
                                "feature_errors", "churn_reasons", "top_customers", "signup_cohorts")
    }
    charts = {p.name[:2] for p in tmp_path.iterdir() if p.name[:2].isdigit()}
    assert charts == {f"{i:02d}" for i in range(1, 16)}
    counts = spark.read.parquet(current(spark, f"{out}/11_retention_priority_distribution")).collect()
    assert len(counts) == 4 and sum(r.accounts for r in counts) == n
    actions = spark.read.option("header", True).csv(current(spark, f"{out}/retention_actions"))
    assert actions.columns == [*ACTION_COLUMNS, "recommended_action"]
    top = [float(r.churn_probability) for r in actions.collect()]
    assert len(top) == 20 and top == sorted(top, reverse=True)
    best = scored.agg({"churn_probability": "max"}).first()[0]
    assert top[0] == pytest.approx(best)
