"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: length of the body (8 bytes), masked CRC-32C of those (4), body, masked CRC-32C of the body (4).
A body is: document id (8), flags (4, bit 0: no id), number of ids (4), then the ids, in 2 bytes each where
the vocabulary allows and in 4 otherwise. All numbers are little-endian. The index holds the offset and the number of ids of
each record (8 bytes each), so that a reader can fetch any record, or deal records out in any order.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.checksums import crc32c, masked
from stayline.llm.storage import TaskFile, commit, in_order, new_folder, open_store, slices

#: Text encoded together, and file bytes read by one task.
RUN_BYTES = 4 << 20
READ_BYTES = 32 << 20
#: Text pieces whose ids a worker remembers, the first ones it meets; later ones are encoded anew.
REMEMBERED = 800_000
_HEAD, _SUM, _BODY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qII")
_NO_ID = 1
_INDEX = np.dtype([("offset", "<u8"), ("ids", "<u8")])


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file of the tokenizers library with byte-level pieces, and the id put behind each document."""

    path: str
    end_id: int = 2


class Encoder:
    """Ids of texts as bytes, the same as encoding each whole text.

    A byte-level vocabulary cuts before every single blank between two characters that are no white space, so
    the stretches between such blanks are encoded once each and remembered. A text with other white space
    next to a blank is encoded whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary.path)
        largest = max(self._tokenizer.get_vocab_size(with_added_tokens=True) - 1, vocabulary.end_id)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self._end = np.array([vocabulary.end_id], self.kind).tobytes()
        self._code = "H" if self.kind.itemsize == 2 else "I"
        self._first: dict[str, bytes | None] = {}
        self._later: dict[str, bytes | None] = {}

    def _learn(self, known: dict[str, bytes | None], pieces: set[str], front: str) -> list[str]:
        """Add the pieces that are not known yet, and return them if they are too many to stay."""
        new = [p for p in pieces if p not in known]
        cut = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(dict.fromkeys(new))
        found = self._tokenizer.encode_batch_fast([front + p for p in cut], add_special_tokens=False)
        for piece, ids in zip(cut, found):
            known[piece] = array(self._code, ids.ids).tobytes()
        return new if len(known) > REMEMBERED else []

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        passing = self._learn(self._first, {c[0] for c in cut}, "")
        more = self._learn(self._later, set(chain.from_iterable(c[1:] for c in cut)), " ")
        out = []
        for text, pieces in zip(texts, cut):
            parts = [self._first[pieces[0]], *map(self._later.__getitem__, pieces[1:]), self._end]
            if None in parts:
                whole = self._tokenizer.encode(text, add_special_tokens=False).ids if text else []
                parts = [np.array(whole, self.kind).tobytes(), self._end]
            out.append(b"".join(parts))
        for known, pieces in ((self._first, passing), (self._later, more)):
            for piece in pieces:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this process, which keeps what it has learnt from task to task."""
    return Encoder(vocabulary)


def frame(bodies: list[bytes]) -> list[bytes]:
    """Whole records for bodies."""
    lengths = [_HEAD.pack(len(b)) for b in bodies]
    sums = crc32c(lengths + bodies)
    n = len(bodies)
    return [
        b"".join((length, _SUM.pack(masked(sums[k])), body, _SUM.pack(masked(sums[n + k]))))
        for k, (length, body) in enumerate(zip(lengths, bodies))
    ]


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Records of one partition; gives one row that describes its files, or none for no rows."""
    encoder = data = None
    index: list[np.ndarray] = []
    for batch in slices(batches, 1, RUN_BYTES):
        if data is None:
            part = batch.column(2)[0].as_py()
            encoder = encoder_of(vocabulary)
            data = TaskFile(folder, f"tokens-{part:06d}.rec")
        ids = batch.column(0).to_pylist()
        found = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
        n_ids = [len(f) // encoder.kind.itemsize for f in found]
        records = frame([_BODY.pack(i or 0, _NO_ID if i is None else 0, n) + f for i, n, f in zip(ids, n_ids, found)])
        entries = np.zeros(len(records), _INDEX)
        entries["ids"] = n_ids
        entries["offset"] = data.size + np.concatenate(([0], np.cumsum([len(r) for r in records])[:-1]))
        index.append(entries)
        data.write(b"".join(records))
    if data is None:
        return
    data.close()
    entries = np.concatenate(index)
    beside = TaskFile(folder, data.name.replace(".rec", ".idx"))
    beside.write(entries.tobytes())
    beside.close()
    yield pa.RecordBatch.from_pylist([{
        "part": part, "name": data.name, "temporary": data.temporary, "index_name": beside.name, "index_temporary": beside.temporary,
        "records": len(entries), "ids": int(entries["ids"].sum()), "bytes": data.size, "width": encoder.kind.itemsize,
    }], _SHARD)


_SHARD = pa.schema([
    ("part", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("index_name", pa.string()), ("index_temporary", pa.string()),
    ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("width", pa.int32()),
])
_SHARD_SQL = (
    "part int, name string, temporary string, index_name string, index_temporary string, records long, ids long, bytes long, width int"
)


def write_tokens(docs: DataFrame, vocabulary: Vocabulary, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> str:
    """Write every document in ascending order of its id and return the folder.

    One file and one index for each partition of the sorted documents; a manifest, written last, names the files that
    count. A null or empty text gives the end id alone. Rows without an id come first, rows with equal ids in the
    order of a hash of their text. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = in_order(narrow, F.col("id").asc_nulls_first(), F.xxhash64("text")).select("id", "text", "_part")
    shards = [r.asDict() for r in rows.mapInArrow(lambda b: _write_shard(b, folder, vocabulary), _SHARD_SQL).collect()]
    shards.sort(key=lambda s: s["part"])
    start = 0
    for shard in shards:
        shard["start"] = start
        start += shard["ids"]
    moves = [(s.pop("temporary"), s["name"]) for s in shards] + [(s.pop("index_temporary"), s["index_name"]) for s in shards]
    commit(folder, moves, json.dumps({"records": sum(s["records"] for s in shards), "ids": start, "shards": shards}).encode())
    return folder


def manifest(folder: str) -> dict:
    store, root = open_store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _index(store, root: str, name: str) -> np.ndarray:
    with store.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), _INDEX)


def _parsed(data: bytes, offsets: np.ndarray, base: int) -> list[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of the records at ``offsets`` of a file of which ``data`` begins at ``base``; checks every sum."""
    heads, bodies, sums = [], [], []
    for offset in (offsets - base).tolist():
        head = data[offset:offset + 8]
        size = _HEAD.unpack(head)[0]
        heads.append(head)
        sums.append((data[offset + 8:offset + 12], data[offset + 12 + size:offset + 16 + size]))
        bodies.append(data[offset + 12:offset + 12 + size])
    found = crc32c(heads + bodies)
    out = []
    for k, (body, (first, second)) in enumerate(zip(bodies, sums)):
        if first != _SUM.pack(masked(found[k])) or second != _SUM.pack(masked(found[len(bodies) + k])):
            raise ValueError(f"damaged record at byte {base + int(offsets[k] - base)}")
        doc_id, flags, _ = _BODY.unpack_from(body)
        out.append((None if flags & _NO_ID else doc_id, body[_BODY.size:]))
    return out


def read_record(folder: str, shard: dict, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard of the manifest, found through the index: doc_id and ids."""
    store, root = open_store(folder)
    index = _index(store, root, shard["index_name"])
    start = int(index["offset"][number])
    end = int(index["offset"][number + 1]) if number + 1 < len(index) else shard["bytes"]
    with store.open_input_file(f"{root}/{shard['name']}") as f:
        data = f.read_at(end - start, start)
    doc_id, ids = _parsed(data, index["offset"][number:number + 1], start)[0]
    return doc_id, np.frombuffer(ids, f"<u{shard['width']}")


def _read(spark: SparkSession, folder: str, value: Callable[[np.ndarray], object], kind: pa.DataType, name: str, sql: str) -> DataFrame:
    """doc_id, start, n_tokens and ``value`` of the ids of every record in the files."""
    ranges = []
    for shard in manifest(folder)["shards"]:
        pieces = max(1, -(-shard["bytes"] // READ_BYTES))
        cuts = [shard["records"] * i // pieces for i in range(pieces + 1)]
        ranges += [(shard["name"], shard["index_name"], shard["width"], shard["bytes"], shard["start"], a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            index = _index(store, root, row["index_name"])
            starts = row["start"] + np.concatenate(([0], np.cumsum(index["ids"][:-1].astype(np.int64))))
            bounds = np.append(index["offset"].astype(np.int64), row["bytes"])
            at = row["first"]
            with store.open_input_file(f"{root}/{row['name']}") as f:
                while at < row["last"]:
                    upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN_BYTES, "right")) - 1)
                    upto = min(upto, row["last"])
                    data = f.read_at(int(bounds[upto] - bounds[at]), int(bounds[at]))
                    found = _parsed(data, bounds[at:upto], int(bounds[at]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array(starts[at:upto]),
                        pa.array(index["ids"][at:upto].astype(np.int64)),
                        pa.array([value(np.frombuffer(ids, f"<u{row['width']}")) for _, ids in found], kind),
                    ], schema=schema)
                    at = upto

    files = spark.createDataFrame(ranges, "name string, index_name string, width int, bytes long, start long, first long, last long")
    return files.repartition(max(1, len(ranges))).mapInArrow(read, f"doc_id long, start long, n_tokens long, {name} {sql}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: doc_id, start (ids of all records before it), n_tokens, ids."""
    return _read(spark, folder, lambda ids: ids.astype(np.int32), pa.list_(pa.int32()), "ids", "array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 4-byte numbers)."""
    return _read(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32", "long")
