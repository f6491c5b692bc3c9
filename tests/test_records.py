import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from stayline.sources import records
from stayline.sources.tables import read_csv_table

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "note", "more")])


def inside_after(text, inside=False):
    """One character at a time: whether a stretch of CSV ends inside quotes."""
    state = "quoted" if inside else "start"
    for c in text:
        if state == "quoted":
            state = "quote" if c == '"' else "quoted"
        elif state == "quote" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "plain"
    return state == "quoted"


@settings(max_examples=500, deadline=None)
@given(st.text('",ab ', max_size=25), st.booleans())
def test_quote_state_of_a_line(line, inside):
    assert records.ends_inside(line, inside) == inside_after(line, inside)


def written(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(SCHEMA.fieldNames())
    writer.writerows(rows)
    return out.getvalue()


def rows_of(seed, n):
    draw = random.Random(seed)
    cell = lambda: "".join(draw.choices(['"', ",", "\n", "x", "yz ", "é", '""', "\n\n", "q\nr"], k=draw.randrange(1, 9)))
    return [(f"k{i}", f"a{cell()}b", cell() if i % 3 else f"tail{i}") for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_several_tasks_read_what_one_reader_reads(spark, tmp_path, end):
    rows = [*rows_of(1, 1500), ("long", "line\n" * 9000, "z"), *rows_of(2, 1500), ("last", 'open "quote" and\nbreak', "ends")]
    (tmp_path / "t.csv").write_text(written(rows, end), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_csv_table(spark, f"{tmp_path}/t.csv", SCHEMA, missing=())
        assert records._lines(spark, f"{tmp_path}/t.csv").rdd.getNumPartitions() > 20
        found = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Spark trims nothing inside quotes; a reader of whole files is the model
    want = sorted(tuple(r) for r in csv.reader(io.StringIO(written(rows))))
    want.remove(SCHEMA_ROW := tuple(SCHEMA.fieldNames()))
    assert [tuple((c or "").replace("\r\n", "\n") for c in r) for r in found] == want and SCHEMA_ROW not in found


def test_several_files_and_headers(spark, tmp_path):
    parts = [rows_of(k, 40) for k in range(5)]
    (tmp_path / "d").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "d" / f"{k}.csv").write_text(written(part))
    got = read_csv_table(spark, f"{tmp_path}/d", SCHEMA, missing=())
    assert sorted(tuple(r) for r in got.collect()) == sorted(r for part in parts for r in part)


def test_files_without_broken_lines_stay_in_the_jvm(spark, tmp_path):
    rows = [("a", 'say ""hi"", 5" wide', "x"), ("b", "", 'quoted, "comma"'), ("c", "plain", "")]
    (tmp_path / "p.csv").write_text(written(rows))
    assert not records.has_broken_lines(spark, f"{tmp_path}/p.csv")
    plain = read_csv_table(spark, f"{tmp_path}/p.csv", SCHEMA)
    assert "MapInArrow" not in plain._jdf.queryExecution().toString()
    cut = read_csv_table(spark, f"{tmp_path}/p.csv", SCHEMA, multi_line=True)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_blank_lines_short_rows_and_an_open_quote(spark, tmp_path):
    (tmp_path / "o.csv").write_text('key,note,more\n\na,"1\n2"\n   \nb,x,y,extra\nc,"never closed\nd,1,2\n')
    got = {r.key: (r.note, r.more) for r in read_csv_table(spark, f"{tmp_path}/o.csv", SCHEMA).collect()}
    assert got["a"] == ("1\n2", None) and got["b"] == ("x", "y") and got.keys() == {"a", "b", "c"}
    (tmp_path / "h.csv").write_text("key,note,more\n")
    assert read_csv_table(spark, f"{tmp_path}/h.csv", SCHEMA, multi_line=True).collect() == []
