"""Token records against whole-text encoding, their files, and what happens to damaged ones."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stayline.llm import token_records as T
from stayline.llm.checksums import crc32c, masked

VOCABULARY = T.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    "Two plain words.", "", None, " lead", "trail ", "double  blank", "tab\t and\nline \n end", "  ", "\n", "a b", "é ü 😀 日本 語", "it's you'll  'd",
    "no break   wide", "<|endoftext|> inside <|endoftext|>", "x" * 3000, "Two plain words.", "x1 22 3,4 -- ??!! a.b", "word " * 5000, "\x1c a \x85 b",
]


def whole(text):
    tokenizer = Tokenizer.from_file(VOCABULARY.path)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_whole_texts(monkeypatch):
    encoder = T.Encoder(VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode([t or "" for t in TEXTS])] == [whole(t) for t in TEXTS]
    monkeypatch.setattr(T, "REMEMBERED", 3)
    small = T.Encoder(VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(b, small.kind).tolist() for b in small.encode([t or "" for t in TEXTS])] == [whole(t) for t in TEXTS]
    assert len(small._later) <= 60


def test_checksums():
    assert crc32c([b"123456789", b"", b"a"]) == [0xE3069283, 0, 0xC1D04330]
    # the four bytes of a length of 8 with their masked sum, as record readers know it
    value = crc32c([struct.pack("<Q", 8)])[0]
    assert masked(value) == ((value >> 15 | value << 17) + 0xA282EAD8) & 0xFFFFFFFF


@pytest.mark.parametrize("partitions", [1, 5])
def test_round_trip(spark, tmp_path, monkeypatch, partitions):
    monkeypatch.setattr(T, "READ_BYTES", 2000)
    ids = [9, 3, 3, None, 1, 4, 40, 41, 42, 43, -5, 7, 8, 10, 11, None, 12, 13, 14]
    rows = list(zip(ids, TEXTS))
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, _part int, id string").repartition(partitions)
    folder = T.write_tokens(docs, VOCABULARY, str(tmp_path / "tokens"))
    found = T.token_digests(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(whole(t))
    for r in found:
        assert r["start"] == start
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()): x for x in left[r["doc_id"]]}
        ids_found = crcs[r["ids_crc32"]]
        left[r["doc_id"]].remove(ids_found)
        assert r["n_tokens"] == len(ids_found)
        start += len(ids_found)
    assert T.manifest(folder)["ids"] == start and T.manifest(folder)["records"] == len(rows)
    full = {r["start"]: (r["doc_id"], r["ids"]) for r in T.read_tokens(spark, folder).collect()}
    # any record by its place in the index
    for shard in T.manifest(folder)["shards"]:
        at = shard["start"]
        for number in range(shard["records"]):
            doc_id, tokens = T.read_record(folder, shard, number)
            assert full[at] == (doc_id, tokens.tolist())
            at += len(tokens)
    assert not [p for p in (tmp_path / "tokens" / "_temporary").iterdir()]


def test_damage_is_found(spark, tmp_path):
    folder = T.write_tokens(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), VOCABULARY, str(tmp_path / "t"))
    (path,) = (tmp_path / "t").glob("*.rec")
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        T.read_tokens(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = T.write_tokens(docs, VOCABULARY, str(tmp_path / "t"))
    assert T.token_digests(spark, folder).count() == 0 and T.manifest(folder)["shards"] == []
