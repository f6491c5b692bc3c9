"""Neighbour voting: terms and votes against plain versions, and accuracy on held-out labels."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stayline.llm import neighbour_votes as nv
from stayline.llm.queries import queries


def plain_terms(text):
    """Pairs of classes, and the four repetitions, in one loop."""
    data = (text or "").encode()
    kinds = [nv._EDGE, *[int(nv._CLASS[b]) for b in data], nv._EDGE]
    pairs = Counter(a * nv.CLASSES + b for a, b in zip(kinds, kinds[1:])) if text is not None else Counter()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    windows = list(zip(words, words[1:], words[2:]))
    lines = [line for line in low.split("\n") if line]
    repeats = [
        sum(a == b for a, b in zip(words, words[1:])),
        sum(a == b for a, b in zip(words, words[2:])),
        len(windows) - len(set(windows)),
        len(lines) - len(set(lines)),
    ]
    return pairs, len(words), repeats


TEXTS = ["", "a", "Ab ab AB", "é ü 中文\n中文", "x y x y x y\n\nx y\nx y", " \t lead and tail \r\n", "!! $$$ 12", "one\0two one\0two", "a b c a b c a"]


def test_terms():
    texts = [*TEXTS, None, *[" ".join(random.Random(i).choices(["aa", "Bb", "ç", "\n", "!"], k=60)) for i in range(30)]]
    counts = nv.term_counts(pa.array(["cut off", *texts], pa.string()).slice(1))
    for text, row in zip(texts, counts):
        pairs, words, repeats = plain_terms(text)
        assert {int(t): int(row[t]) for t in np.flatnonzero(row[: nv.PAIRS])} == dict(pairs)
        assert row[nv.PAIRS : nv.PAIRS + nv.WORDS].sum() == words and row[nv.PAIRS + nv.WORDS :].tolist() == repeats
    words = nv.term_counts(pa.array(["Same same", "same"]))[:, nv.PAIRS : nv.PAIRS + nv.WORDS]
    assert (words[0] == 2 * words[1]).all()


def test_long_text_in_stretches(monkeypatch):
    draw = random.Random(1)
    text = " ".join("".join(draw.choices("abcé!", k=5)) for _ in range(3000))
    whole = nv.term_counts(pa.array([text, "x"]))
    monkeypatch.setattr(nv, "RUN_BYTES", 700)
    cut = nv.term_counts(pa.array([text, "x"]))
    # nothing is lost where a stretch ends but the pair across the cut, which becomes two pairs at edges
    assert cut[0, nv.PAIRS : nv.PAIRS + nv.WORDS].tolist() == whole[0, nv.PAIRS : nv.PAIRS + nv.WORDS].tolist()
    assert (cut[1] == whole[1]).all() and 0 <= cut[0, : nv.PAIRS].sum() - whole[0, : nv.PAIRS].sum() < 30
    assert nv.term_counts(pa.array(["x" * 5000])).sum() > 0


def test_votes_against_a_plain_loop():
    draw = np.random.default_rng(2)
    counts = draw.poisson(0.3, (80, nv.TERMS))
    space = nv.Space(draw.random(nv.TERMS).astype(np.float32), nv.singular_axes(draw.standard_normal((60, nv.TERMS)).astype(np.float32), 8, 1))
    label = (np.arange(50) % 3 > 0).astype(float)
    voters = nv.Voters(space, space.vectors(counts[:50]), label, np.where(label > 0, 2.0, 1.0), 5, 4)
    got = voters.scores(counts)
    for row, found in zip(space.vectors(counts), got):
        near = [max(0.0, float(row @ v)) for v in voters.vectors]
        last = sorted(near)[-5]
        votes = [(s**4 * w, y) for s, w, y in zip(near, voters.weight, label) if s >= last - 1e-6]
        total = sum(v for v, _ in votes)
        assert found == pytest.approx(sum(v * y for v, y in votes) / total if total else 2 * label.sum() / voters.weight.sum(), abs=1e-3)


def test_axes_span_the_leading_directions():
    draw = np.random.default_rng(3)
    rows = (draw.standard_normal((200, 5)) * [9, 7, 5, 3, 2]) @ np.linalg.qr(draw.standard_normal((300, 5)))[0].T + 0.01 * draw.standard_normal((200, 300))
    axes = nv.singular_axes(rows.astype(np.float32), 3, 1)
    exact = np.linalg.svd(rows, full_matrices=False)[2][:3]
    assert np.allclose(np.linalg.svd(exact @ axes)[1], 1, atol=1e-3)


def _corpus():
    draw = random.Random(7)
    good = [" ".join(draw.choices(["the", "of", "river", "and", "stone", "a"], k=40)) + "." for _ in range(120)]
    junk = [" ".join(f"{w}$$$" for w in draw.choices(["the", "of", "river"], k=40)) for _ in range(60)]
    return [(i, t, int(i < 120)) for i, t in enumerate(good + junk)]


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y, 0) for i, _, y in rows]
    changed = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y, 0) for i, y, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (sorted(map(tuple, nv.classify(docs, spark.createDataFrame(r, schema)).drop("text").collect())) for r in (labels, changed))
    assert one == two
    assert all(flag == (zlib.crc32(str(i).encode()) % 3 == 1) and predicted == y for (i, flag, _, predicted), (_, _, y) in zip(one, rows))


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated ids and rows, contradicting, missing and strange labels, clashing names."""
    rows = _corpus()
    more = [(None, "no id"), (500, None), (501, ""), (502, "word " * 500_000), *[(503, "copy copy")] * 40, *[(2, "other text")] * 30]
    docs = spark.createDataFrame([(*r[:2], 9.0) for r in rows] + [(*r, 9.0) for r in more], "doc_id long, text string, score double").repartition(4)
    labels = [(i, y) for i, _, y in rows] + [(0, 0), (0, 1), (9999, 1), (None, 1), (501, None), (502, 7), (503, 0), (503, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.doc_id for r in nv.labelled_ids(docs, told).collect()}.isdisjoint({0, 9999, None, 501, 502})
    got = nv.classify(docs, told).collect()
    assert len(got) == len(rows) + len(more) and got[0].__fields__ == ["doc_id", "text", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.text == "copy copy"}) == 1


def test_small_samples_and_empty_tables(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    voters = nv.fit(docs, labels, nv.Settings(sample=10, dimensions=4))
    assert len(voters.label) == 20 and voters.weight.sum() == pytest.approx(sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows))
    assert nv.score(docs, voters).where("predicted <> int(doc_id < 120)").count() == 0
    assert {r.score for r in nv.classify(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in nv.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert nv.classify(docs.where("false"), labels).collect() == []


def test_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op11_quality_votes"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    tested = [(told[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in told]
    assert len(tested) > 100 and sum(a == b for a, b in tested) / len(tested) > 0.95
