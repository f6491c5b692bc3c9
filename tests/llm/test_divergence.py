"""The source audit against plain sums over dictionaries."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stayline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_version(rows, least_docs=3, top=200):
    """rows: (text, lang, source)."""
    found, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", terms(text)
        found[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in sorted({lang for lang, _ in found}):
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        sources = [s for at, s in found if at == lang]
        total = Counter()
        for s in sources:
            total.update(found[lang, s])

        def shares(counts, kept=kept):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        p = {s: shares(found[lang, s]) for s in sources}
        q = shares(total)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            more = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", pairs), ("term", more)):
                ranked = sorted(ranked, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def random_rows(seed, n, words, sources):
    draw = random.Random(seed)
    return [
        (
            draw.choice([None, "", " ".join(draw.choices(words, k=draw.randrange(1, 40))), " 12 -- "]),
            draw.choice(["en", "en", "", None, "de"]),
            # a third of all rows from one source
            "hot" if draw.random() < 0.33 else draw.choice(sources),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed, sources", [(1, ["a", "b", None, "", "Z", "é"]), (2, ["only"]), (3, [f"s{i}" for i in range(40)])])
def test_against_plain_sums(spark, seed, sources, monkeypatch):
    words = ["the", "The", "über", "Über", "a", "ÀB", "中文", "x1y", "co-op", "don't", "z\0q", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]]
    rows = random_rows(seed, 400, words, sources) + [("rare rarer", "fr", "a"), (None, "it", None), ("", "it", "x"), ("lone word", "it", "y")]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, value int, term string").repartition(5)
    for cells in (1 << 19, 300):  # one block, many blocks
        monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
        got = sorted(tuple(r) for r in divergence.audit(docs).collect())
        assert got == plain_version(rows)
    assert divergence.audit(docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_settings_and_empty_table(spark):
    rows = random_rows(4, 200, ["one", "two", "three", "four"], ["a", "b"])
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.audit(docs, divergence.Settings(least_docs=1, top_terms=2))
    assert sorted(tuple(r) for r in got.collect()) == plain_version(rows, 1, 2)
    assert divergence.audit(docs.where("false")).collect() == []


def test_long_text_and_repeated_rows(spark):
    rows = [("Ab cd " * 300_000, "en", "a")] + [("ab ef ab", "en", "b")] * 500 + [("cd", "en", "a")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain_version(rows)


def test_large_counts_stay_exact(spark):
    counts = [("en", "a", "x", 10**13), ("en", "a", "y", 3), ("en", "b", "x", 10**12 + 7)]
    kept = spark.createDataFrame([(*c, 0, c[1] == "a") for c in counts], "lang string, source string, term string, n long, lang_n long, leads boolean")
    sizes = {r.source: r for r in divergence._sizes(kept).collect()}
    assert sizes["a"].size == 10**13 + 5 and sizes["a"].zero == 1 and sizes["b"].lang_size == 10**13 + 10**12 + 12
    (share,) = kept.where("source = 'b'").select(divergence._share(kept["n"], kept["n"] + 2).alias("p")).first()
    assert share == 1 + 10**9 * (10**12 + 8) // (10**12 + 9)


def test_terms_break_at_texts():
    row, found = divergence.terms_of(pa.array(["Ab", "cD e", "", "é!", "x"]).slice(1))
    assert row.tolist() == [0, 0, 2, 3] and [t.decode() for t in found.to_pylist()] == ["cd", "e", "é", "x"]
    row, found = divergence.terms_of(pa.array(["", "", "1"]))
    assert len(row) == 0 and len(found) == 0


def test_scatter_in_runs(monkeypatch):
    draw = np.random.default_rng(5)
    cells = np.unique(draw.integers(0, 30 * 50, 700))
    zero = draw.integers(1, 50, 30)
    rows = divergence.Rows(zero, cells // 50, cells % 50, draw.integers(50, 10**6, len(cells)))
    whole = [rows.scattered(i).tolist() + [b.tolist() for b in rows.baselines(i)] for i in range(30)]
    monkeypatch.setattr(divergence, "SCATTERED", 40)
    assert whole == [rows.scattered(i).tolist() + [b.tolist() for b in rows.baselines(i)] for i in range(30)]


def test_memory_of_counting():
    """A worker's arrays do not grow with the batch that Spark hands over."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(5_000)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(9_000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "source": [f"s{i % 20}" for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    try:
        given = list(divergence._counted(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.column(2).nbytes > 16_000_000 and peak < 80_000_000
    want = Counter((f"s{i % 20}", t) for i, text in enumerate(texts) for t in text.split())
    found = Counter()
    for r in pa.Table.from_batches(given).to_pylist():
        found[r["source"], r["term"]] += r["n"]
    assert {k: n for k, n in found.items() if k[1] is not None} == want and sum(b.num_rows for b in given) == len(want) + 20


def test_counts_held_and_given_out(monkeypatch):
    rows = [("en", f"s{i % 3}", f"w{chr(97 + i % 26)} w{chr(97 + i % 7)} same same") for i in range(500)] + [("en", "s9", "")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r)) for r in rows])
    monkeypatch.setattr(divergence, "RUN_BYTES", 60)

    def summed():
        n, docs = Counter(), Counter()
        for r in (r for b in divergence._counted(iter([batch])) for r in b.to_pylist()):
            n[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
        return n, docs

    whole = summed()
    assert whole[0]["en", "s0", "same"] == 334 and whole[1]["en", "s0", "same"] == 167 and ("en", "s9", None) in whole[0]
    for held in (1, 10, 60):
        monkeypatch.setattr(divergence, "HELD_ROWS", held)
        assert summed() == whole
