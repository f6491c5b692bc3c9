import pytest
from pyspark.sql import functions as F

from stayline.operators import actions as A

SCHEMA = "account_id string, account_name string, industry string, mrr_amount int, value_segment string, churn_probability double"


def frame(spark, rows):
    return spark.createDataFrame([(f"{i:03d}", f"n{i}", "x", *r) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    "segment,p,priority",
    [
        ("High Value", 0.60, A.P1), ("High Value", 0.599, A.P3), ("High Value", 0.40, A.P3), ("High Value", 0.399, A.P4),
        ("Mid Value", 0.60, A.P2), ("Mid Value", 0.50, A.P2), ("Mid Value", 0.499, A.P3), ("Mid Value", 0.399, A.P4),
        ("Low Value", 0.95, A.P3), ("Low Value", 0.40, A.P3), ("Low Value", 0.399, A.P4), ("Unknown", 0.70, A.P3),
        (None, 0.45, A.P3), ("High Value", None, A.P4), ("High Value", float("nan"), A.P4),
    ],
)
def test_priority_rules(spark, segment, p, priority):
    assert A.add_priority(frame(spark, [(1, segment, p)])).first().retention_priority == priority


def test_absent_priorities_stay_in_the_tables(spark):
    df = A.add_priority(frame(spark, [(10, "Low Value", 0.5), (20, "Low Value", 0.7), (None, "Low Value", 0.1)]))
    assert [tuple(r) for r in A.by_priority(df).collect()] == [
        (A.P1, 0, None, None), (A.P2, 0, None, None), (A.P3, 2, pytest.approx(0.6), 30), (A.P4, 1, pytest.approx(0.1), 0),
    ]
    assert sum(r.accounts for r in A.priority_counts(df).collect()) == 3


def test_impact_counts_unknown_probability_as_no_risk(spark):
    df = A.add_priority(frame(spark, [(100, "High Value", 0.9), (1000, "High Value", float("nan")), (10, "Low Value", 0.4)]))
    impact = A.business_impact(df)
    assert tuple(impact.first()) == (110, 100, 1)
    assert tuple(A.impact_text(impact).first()) == ("$110", "$100", "1")


def test_top_accounts_order_and_actions(spark):
    rows = [(1, "Low Value", 0.5)] * 30 + [(5, "High Value", 0.9), (2, "Mid Value", float("nan")), (2, "Mid Value", None)]
    top = A.top_accounts(A.add_priority(frame(spark, rows))).collect()
    assert len(top) == 20 and top[0].account_name == "n30"
    assert [r.account_name for r in top[1:]] == [f"n{i}" for i in range(19)]
    assert top[0].recommended_action == "Immediate call + custom discount"
    assert top[1].recommended_action == "Automated nudges / offers"
    assert list(top[0].asDict()) == [*A.ACTION_COLUMNS, "recommended_action"]


def test_unknown_priority_has_no_action(spark):
    df = spark.createDataFrame([("P9",)], "retention_priority string")
    assert A.add_action(df).select(F.col("recommended_action").isNull().alias("x")).first().x
