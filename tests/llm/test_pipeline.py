"""The whole pipeline against its stages in plain Python."""

import corpus_pipeline
from stayline.llm import mixing, quality
from stayline.llm.sharding import place_of
from test_decontaminate import plain_distance
from test_mixing import poisson, uniform
from test_quality import plain as measured
from test_simhash import plain_components, plain_fingerprint

from stayline.llm.decontaminate import words_of


def keeps(text):
    n, chars, symbols, lines, repeated_lines, repeated = measured(text)
    return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 2 * repeated_lines > lines or chars < 3 * n or chars > 12 * n)


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    bench = [words_of(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r in rows if keeps(r[1])]
    labels = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows], 3)
    rows = [r for r, c in zip(rows, labels) if r[0] == c]
    leaks = set()
    for i, t, _ in rows:
        words = words_of(t)
        present = set(words)
        for item in bench:
            budget = len(item) // 5
            if sum(w in present for w in item) >= len(item) - budget and plain_distance(item, words) <= budget:
                leaks.add(i)
    assert leaks
    rows = [r for r in rows if r[0] not in leaks]
    known = {r["source"]: r["rate"] for r in mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = sorted(i for i, t, s in rows for _ in range(poisson(known[s], uniform("mix-1", i))))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*docs.columns, "row_number", "shard", "slot"]
    out = found.collect()
    assert sorted(r["doc_id"] for r in out) == want
    texts = {i: t for i, t, _ in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    assert all(place_of(r["row_number"], len(out), corpus_pipeline.SHARDS) == (r["shard"], r["slot"]) for r in out)


def test_stages_on_odd_documents(spark, folder):
    text = " ".join(f"sentence{i} with words" for i in range(60))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " end", "en", None, None), (2, None, None, "b", 0), (3, "", "en", "b", 0), (4, "x " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = at == len(corpus_pipeline.STAGES) - 1
        for given in (docs, docs.where("false")):
            out = stage(spark, given, folder)
            assert out.columns[: len(docs.columns)] == docs.columns and (last or out.columns == docs.columns)
            assert given is docs or out.count() == 0
        out = [r["doc_id"] for r in stage(spark, docs, folder).collect()]
        if at == 0:
            assert sorted(out, key=repr) == [1, 1, None]
        if at == 1:
            assert sorted(out, key=repr) == sorted([1, 2, 4], key=repr)
    assert quality.STANDARD.mask == 31
