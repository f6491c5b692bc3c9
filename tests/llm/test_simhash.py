"""Fingerprints and their components against a plain computation over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stayline.llm import simhash
from stayline.llm.components import components


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance):
    """Smallest id reachable for each (id, fingerprint), by repeated minima over all pairs."""
    fps = np.array([fp for _, fp in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = np.array([float("inf") if i is None else i for i, _ in rows])
    while True:
        new = np.where(near, label[None, :], float("inf")).min(1)
        if (new == label).all():
            return [None if v == float("inf") else int(v) for v in label]
        label = new


def result(df):
    return sorted(((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in df.collect()), key=repr)


def expected(rows, distance=3):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    return sorted([(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps, distance))], key=repr)


def test_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(simhash.near_duplicates(docs)) == expected(rows)


def test_odd_rows(spark):
    long_text = " ".join(f"word{k % 977}" for k in range(400_000))
    rows = [
        (5, None), (3, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (4, "two words"), (None, "two words"), (6, "Été à la mer"), (12, "other text with words"),
        (7, long_text), (8, long_text.upper()), (10, "no break stays one word"), (10, "no break stays one word"), (None, None), (11, "a b c d"), (None, "lonely row here"),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, k1 int, component_id int")
    found = simhash.near_duplicates(docs)
    assert result(found) == expected(rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    groups = {}
    for (i, t), c, fp in zip(rows, plain_components([(i, plain_fingerprint(t)) for i, t in rows], 3), [plain_fingerprint(t) for _, t in rows]):
        groups.setdefault(c if c is not None else fp, []).append(i)
    assert len(got) == len(groups)
    assert sorted(repr(i) for i, _ in got) == sorted(repr(min((i for i in ids if i is not None), default=None)) for ids in groups.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize(("distance", "shared"), [(1, 0), (2, 20), (3, 0), (3, 40), (4, 30)])
def test_links_of_random_fingerprints(spark, monkeypatch, distance, shared):
    """Dense, correlated and hot fingerprints: the links connect what all pairs connect."""
    monkeypatch.setattr(simhash, "PLAIN_KEY", 8)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    draw = random.Random(distance * 100 + shared)
    centres = [draw.getrandbits(64) for _ in range(15)]
    fps = {0, (1 << 64) - 1}
    for _ in range(700):
        fp = draw.choice(centres) if draw.random() < 0.7 else draw.getrandbits(64 - shared)
        for _ in range(draw.randrange(6)):
            fp ^= 1 << draw.randrange(64)
        fps.add(fp)
    fps = sorted(fps)
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    uniq = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)
    roots = {r["node"]: r["root"] for r in components(simhash.links(uniq, distance)).collect()}
    got, want = {}, {}
    for k, c in enumerate(plain_components(list(enumerate(fps)), distance)):
        want.setdefault(c, set()).add(signed[k])
        got.setdefault(roots.get(signed[k], signed[k]), set()).add(signed[k])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_meet_the_pigeonhole_sum(spark):
    uniq = spark.range(500).select(F.xxhash64("id").alias("fp"))
    plan = simhash.make_plan(uniq, 3)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    bits = simhash._bits(np.arange(40, dtype=np.uint64))
    thresholds, cost = plan.thresholds(bits)
    assert (thresholds.sum(1) == 3 - len(plan.groups) + 1).all() and (thresholds >= -1).all() and (cost > 0).all()


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(200)] + [(7, 7), (5, 6), (6, 5)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 1000: 1000, **{2000 + k: 1000 for k in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
