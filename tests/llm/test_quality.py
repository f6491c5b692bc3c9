"""The ledger on odd texts against plain Python, and what policies and ablations make of it."""

import re
from collections import Counter

from pyspark.sql import functions as F

from stayline.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "no break é ü # $$", "l\nl\n\nl \nl", "a b c d a b c\vd\fe",
    " ".join("one two three four".split() * 30), " ".join(f"w{i}" for i in range(60_000)), "# | # | " * 40, "ab " * 3 + "cd ef ab ab ab",
    " ".join(f"word{i % 700}" for i in range(5000)), "a a b a a b a a", "😀 😀 😀 😀",
]


def test_measurements(spark):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_words int, doc string")
    found = {r["doc_id"]: tuple(r[m] for m in quality.MEASUREMENTS) for r in quality.ledger(docs).collect()}
    assert found == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_keep_and_ablation(spark):
    good = " ".join(f"sentence{i} words" for i in range(40))
    texts = [None, "", good, good, good + " #" * 20, " ".join(["same old words"] * 30), "few words", "\n".join(["a line " + good] + ["again"] * 9)]
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)], "doc_id int, text string, _words string, failed_rules int")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in quality.keep(docs, quality.BASE).collect()) == [2, 3, 4, 7]
    rows = {(r["policy"], r["rule"]): r for r in quality.ablation(quality.ledger(docs.select("doc_id", "text"))).collect()}
    assert {k[1] for k in rows if k[0] == "base-1"} == {"few_words", "repeated_words"}
    assert (rows["standard-1", "symbols"]["only_this"], rows["standard-1", "symbols"]["removed"], rows["standard-1", "symbols"]["total"]) == (1, 6, 8)
    assert rows["standard-1", "few_words"]["failed"] == 3 and rows["base-1", "repeated_words"]["only_this"] == 1


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert quality.ledger(docs).count() == quality.keep(docs).count() == 0
    assert quality.ablation(quality.ledger(docs)).count() == 0
    plan = quality.keep(spark.range(3).select(F.col("id").cast("string").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([("a b c", 1, 2.0, "x", "y")], "text string, _words int, _dense double, _lines string, __words string")
    (row,) = quality.measure(docs).collect()
    assert (row["_words"], row["_dense"], row["_lines"], row["__words"], row["n_words"]) == (1, 2.0, "x", "y", 3)
    assert quality.keep(docs).columns == docs.columns
