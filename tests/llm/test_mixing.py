"""Rates, draws and the shape of the mix."""

import hashlib
import math

from pyspark.sql import functions as F

from stayline.llm import mixing
from stayline.llm.mixing import Mix


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def uniform(seed, row):
    return int(hashlib.md5(f"{seed}:{row}".encode()).hexdigest()[:13], 16) / 2**52


def test_draws_and_order(spark):
    rows = [(i, "t" * (i % 50), ["a", "b", None][i % 3], i) for i in range(900)] + [(5, "other", "a", 0), (5, "other", "a", 0), (None, "no id", "b", 1), (None, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long").repartition(4)
    known = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    mixed = mixing.replicate(docs)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    found = mixed.collect()
    want = []
    for i, t, s, _ in rows:
        row = i if i is not None else t if t is not None else "null"
        want += [(i, t, s, k) for k in range(poisson(known[s], uniform("mix-1", row)))]
    assert sorted(((r["doc_id"], r["text"], r["source"], r["copy"]) for r in found), key=repr) == sorted(want, key=repr)
    keys = [r["mix_key"] for r in found]
    assert keys == sorted(keys)
    again = mixing.replicate(docs.repartition(7)).select("doc_id", "copy").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixed.select("doc_id", "copy").collect())
    other = mixing.replicate(docs, Mix(seed="x")).select("doc_id", "copy").collect()
    assert sorted(map(repr, again)) != sorted(map(repr, other))


def test_target_shares(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w"), 99).alias("text"), F.when(F.col("id") % 3 < 1, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source")
    )
    weights = (("hot", 1.0), ("s0", 3.0), ("s1", 6.0))
    mix = Mix(weights=weights, epochs=2.0)
    counts = {r["source"]: r["n"] for r in mixing.replicate(docs, mix).groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    assert abs(total - 60_000) < 1500 and set(counts) == {"hot", "s0", "s1"}
    for source, weight in weights:
        assert abs(counts[source] / total - weight / 10) < 0.01


def test_large_rates(spark):
    """A source of one byte beside a large one is drawn in parts, as the SQL has it."""
    docs = spark.createDataFrame([(1, "", "x"), (None, None, "y")], "doc_id long, text string, source string")
    large = spark.range(4).select(F.col("id") + 10, F.repeat(F.lit("b"), 2000), F.lit("z"))
    mix = Mix(weights=(("x", 3.0), ("y", 1.0)))
    found = mixing.replicate(docs.union(large), mix).collect()
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs.union(large), mix).collect()}
    assert rate["x"] > 6000 and 2000 < rate["y"] < 2002 and rate["z"] == 0
    for source, who in (("x", 1), ("y", "null")):
        parts = math.ceil(rate[source] / 500)
        want = sum(poisson(rate[source] / parts, uniform("mix-1", f"part:{k}:{who}")) for k in range(1, parts + 1))
        assert sorted(r["copy"] for r in found if r["source"] == source) == list(range(want)) and abs(want / rate[source] - 1) < 0.1
    assert len({r["mix_key"] for r in found}) == len(found)


def test_large_rates_in_sql(spark, tmp_path):
    import duckdb

    from compare import duck_rows, spark_rows
    from stayline.llm.oracle import oracle_sql
    from stayline.llm.queries import queries

    rows = [(1, "", "en", "tiny", 0), (2, None, None, None, None)] + [(10 + i, "word " * 30_000, "en", f"s{i % 12}", 9) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mixing.rates(spark.read.parquet(f"{tmp_path}/documents.parquet")).agg({"rate": "max"}).first()[0] > 100
    assert spark_rows(queries()["op4_mix_sources"](spark, str(tmp_path))) == duck_rows(con, oracle_sql()["op4_mix_sources"])


def test_steps_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b" * 9000, "y")], "doc_id long, text string, source string")
    assert mixing.replicate(docs.where("false")).count() == 0
    steps = docs.select(mixing._steps(F.lit(400.0)).alias("s")).first()["s"]
    assert len(steps) == 681 and abs(steps[-1] - 1) < 1e-12 and abs(steps[400] - 0.5) < 0.03


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, source string")
    plan = mixing.replicate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
