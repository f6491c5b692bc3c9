"""The permutation and the shards it makes."""

import zlib
from collections import Counter

import numpy as np
import pytest

from stayline.llm import sharding
from stayline.llm.sharding import Permutation, number_at, place_of


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 64, 65, 1000, 4097])
def test_permutation(n):
    numbers = np.arange(n)
    out = Permutation(n, 7).forward(numbers)
    assert sorted(out) == list(range(n))
    assert (Permutation(n, 7).inverse(out) == numbers).all()
    if n > 60:
        assert (out != Permutation(n, 8).forward(numbers)).any() and np.corrcoef(numbers, out)[0, 1] ** 2 < 0.1


def test_large_numbers():
    n = 10**12 + 39
    numbers = np.array([0, 1, n - 1, n // 2])
    out = Permutation(n, 1).forward(numbers)
    assert (out < n).all() and (out >= 0).all() and (Permutation(n, 1).inverse(out) == numbers).all()
    assert number_at(*place_of(12345, n, 24, 3), n, 24, 3) == 12345


def test_assignment_does_not_depend_on_the_layout(spark):
    rows = [(i, f"t{i}", 1, 2) for i in range(500)] + [(7, "same", 1, 2)] * 120 + [(None, None, None, None)] * 90 + [(8, "", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _part int, shard int")
    results = []
    for partitions in (1, 6):
        found = sharding.assign(docs.repartition(partitions), shards=24).collect()
        results.append(sorted(map(repr, found)))
        assert found[0].asDict().keys() == {"doc_id", "text", "_part", "row_number", "shard", "slot"}
        assert sorted(r["row_number"] for r in found) == list(range(len(rows)))
        slots = {}
        for r in found:
            assert place_of(r["row_number"], len(rows), 24) == (r["shard"], r["slot"])
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert results[0] == results[1]


def test_few_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    (row,) = sharding.assign(docs).collect()
    assert (row["row_number"], row["shard"], row["slot"]) == (0, 0, 0)
    assert sharding.assign(docs.where("false")).count() == 0


def plain_place(number, n, shards, seed=0):
    """Shard and slot of a row number by the network written out in whole numbers."""
    mask64 = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    bits = 1
    while 4**bits < n:
        bits += 1
    keys = [mixed((seed + (k + 1) * 0x9E3779B97F4A7C15) & mask64) for k in range(6)]
    at = number
    while True:
        left, right = at >> bits, at & (1 << bits) - 1
        for key in keys:
            left, right = right, left ^ mixed(right + key & mask64) & (1 << bits) - 1
        at = left << bits | right
        if at < n:
            return at % shards, at // shards


def test_registered_query(spark, folder):
    from stayline.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries()["op9_shard"](spark, folder).collect()
    assert rows[0].__fields__[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == len(texts)
    number = {doc_id: k for k, doc_id in enumerate(sorted(texts))}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        assert (r.shard, r.slot) == plain_place(number[r.doc_id], len(texts), 24)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
