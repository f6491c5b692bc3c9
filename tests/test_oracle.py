"""Every query with a SQL text gives the same names, types and rows in DuckDB."""

import pytest

import __spark_entry__
import workload.queries
from compare import connect, duck_rows, duck_types, spark_rows

QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()
NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_sql_text_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(workload.queries.queries()) - set(ORACLE) == {
        "model_comparison", "held_out_roc_curve", "scored_accounts", "feature_importance", "model_retention_actions",
    }


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(workload.queries.queries())))
def test_same_result(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    kinds = {f.name: NAMES[f.dataType.simpleString()] for f in df.schema.fields}
    assert kinds == duck_types(duck, ORACLE[name])
    assert spark_rows(df) == duck_rows(duck, ORACLE[name])
