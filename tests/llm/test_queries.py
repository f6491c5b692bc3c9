"""The registered training-data queries that SQL can express, side by side in two engines."""

import pytest

from compare import connect, duck_rows, duck_types, spark_rows
from stayline.llm.oracle import oracle_sql
from stayline.llm.queries import queries

NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_result(spark, folder, name):
    duck = connect(folder)
    df = queries()[name](spark, folder)
    assert {f.name: NAMES[f.dataType.simpleString()] for f in df.schema.fields} == duck_types(duck, oracle_sql()[name])
    assert spark_rows(df) == duck_rows(duck, oracle_sql()[name])
