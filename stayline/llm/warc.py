"""Pages as WARC files: deterministic, sharded, with repeated payloads as revisit records.

Records are sorted by page id over all shards. Shard bounds come from exact byte counts of ranges of ids, not from
a sample, so the same pages give the same files whatever the number of cores. Within a shard, files roll by
compressed size. Headers, record ids and digests are written anew from the payload. Tasks write under
temporary names; the driver moves what succeeded and writes a manifest last.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.storage import TaskFile, commit, new_folder, open_store, stored

#: Ranges of ids that are counted in one round.
_CELLS = 4096
_READ = 1 << 20
_CRLF = b"\r\n"


@dataclass(frozen=True)
class Settings:
    """``shard_bytes`` of payload make a shard (the work of one task); a file ends once it has ``roll_bytes`` compressed. Payloads from
    ``least_bytes`` are stored once. ``date`` stands in every record, so that a second run gives the same bytes."""

    shard_bytes: int = 32 << 20
    roll_bytes: int = 16 << 20
    least_bytes: int = 1000
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


DEFAULT = Settings()


# ranges of ids


def _cell_sizes(sized: DataFrame, low: int, high: int, span: int) -> dict[int, int]:
    """Bytes of each range of ``span`` ids from ``low`` up to ``high``; at most ``_CELLS`` rows reach the driver."""
    within = sized.where((F.col("page_id") >= low) & (F.col("page_id") <= high))
    cell = F.expr(f"CAST((CAST(page_id AS DECIMAL(38,0)) - {low}) DIV {span} AS LONG)")
    return {r["cell"]: r["n"] for r in within.groupBy(cell.alias("cell")).agg(F.sum("size").alias("n")).collect()}


def shard_bounds(sized: DataFrame, shard_bytes: int) -> tuple[list[int], list[int]]:
    """Lower ids of the shards, and into how many parts each is split.

    Ranges of ids that hold more than ``shard_bytes`` are counted again in finer ranges; a single id that still does is
    split by the hash of its payloads. ``sized`` has page_id and size.
    """
    ends = sized.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if ends["low"] is None:
        return [0], [1]
    cells: list[tuple[int, int, int]] = []
    open_ranges = [(ends["low"], ends["high"])]
    while open_ranges:
        low, high = open_ranges.pop()
        span = -(-(high - low + 1) // _CELLS)
        for cell, size in sorted(_cell_sizes(sized, low, high, span).items()):
            start = low + cell * span
            if size > shard_bytes and span > 1:
                open_ranges.append((start, min(start + span - 1, high)))
            else:
                cells.append((start, size, span))
    bounds, parts, filled = [], [], 0
    for start, size, _ in sorted(cells):
        heavy = -(-size // shard_bytes)
        if not bounds or heavy > 1 or parts[-1] > 1 or filled + size > shard_bytes:
            bounds.append(start)
            parts.append(heavy)
            filled = 0
        filled += size
    return bounds, parts


# records


def _sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def _record_id(*parts: object) -> bytes:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>".encode()


def _record(fields: list[tuple[bytes, bytes]], block: bytes, level: int) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    head = b"WARC/1.1" + _CRLF + b"".join(k + b": " + v + _CRLF for k, v in fields)
    head += b"Content-Length: " + str(len(block)).encode() + _CRLF + _CRLF
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + block + _CRLF + _CRLF) + packer.flush()


def _header_value(text: str | None) -> bytes:
    """A header value: line breaks and other control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "").encode()


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, settings: Settings, copy: int = 0) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names the page that holds the payload. ``copy`` counts the rows
    of this page, address and payload before it, so that every record has an id of its own."""
    hexed = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + _CRLF + _CRLF
    revisit = refers_to is not None
    block = http if revisit else http + payload
    kind = b"revisit" if revisit else b"response"
    fields = [
        (b"WARC-Type", kind),
        (b"WARC-Record-ID", _record_id(kind, page_id, url, hexed, *([copy] if copy else []))),
        (b"WARC-Date", settings.date.encode()),
        (b"WARC-Target-URI", _header_value(url)),
        (b"WARC-Payload-Digest", _sha1(payload)),
        (b"WARC-Block-Digest", _sha1(block)),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"X-Payload-Length", str(len(payload)).encode()),
    ]
    if page_id is not None:
        fields.append((b"X-Page-ID", str(page_id).encode()))
    if revisit:
        fields += [
            (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            (b"X-Refers-To-Page-ID", str(refers_to).encode()),
        ]
    return _record(fields, block, settings.level)


def _info_record(name: str, settings: Settings) -> bytes:
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    fields = [
        (b"WARC-Type", b"warcinfo"),
        (b"WARC-Record-ID", _record_id("warcinfo", name)),
        (b"WARC-Date", settings.date.encode()),
        (b"WARC-Filename", name.encode()),
        (b"Content-Type", b"application/warc-fields"),
    ]
    return _record(fields, block, settings.level)


# writing

_FILE = "shard int, name string, temporary string, records long, bytes long, sha1 string"


class _Roll:
    """Files of one shard, one after the other."""

    def __init__(self, folder: str, shard: int, settings: Settings):
        self.folder, self.shard, self.settings = folder, shard, settings
        self.number, self.file, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.file is None:
            self.file = TaskFile(self.folder, f"pages-{self.shard:06d}-{self.number:04d}.warc.gz")
            self.sum, self.records = hashlib.sha1(), 0
            self._put(_info_record(self.file.name, self.settings))
        self._put(record)
        self.records += 1
        if self.file.size >= self.settings.roll_bytes:
            self.end()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sum.update(data)

    def end(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append({
                "shard": self.shard, "name": self.file.name, "temporary": self.file.temporary, "records": self.records,
                "bytes": self.file.size, "sha1": self.sum.hexdigest(),
            })
            self.file, self.number = None, self.number + 1


def _write(batches: Iterator[pa.RecordBatch], folder: str, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Write sorted rows (shard, page_id, digest, is_page, url, html, refers_to). A row that is no page says that the pages of
    its id and digest behind it repeat the payload of page ``refers_to``."""
    roll = said = held = last = None
    copy = 0
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        columns[5] = columns[5].cast(pa.binary())
        for row in range(batch.num_rows):
            shard, page_id, digest, is_page, url, html, refers_to = (c[row].as_py() for c in columns)
            if roll is None or roll.shard != shard:
                if roll is not None:
                    roll.end()
                    yield from _described(roll)
                roll, said, held = _Roll(folder, shard, settings), None, None
            if not is_page:
                said = (page_id, digest, refers_to)
                continue
            target = said[2] if said is not None and said[:2] == (page_id, digest) else None
            if target is not None and target == page_id:
                # this page id holds the payload itself; of repeated rows the first is the response
                target, held = (page_id if held == (page_id, digest) else None), (page_id, digest)
            kind = target is None
            copy = copy + 1 if last == (page_id, digest, url, kind) else 0
            last = (page_id, digest, url, kind)
            roll.add(_page_record(page_id, url, html or b"", target, settings, copy))
    if roll is not None:
        roll.end()
        yield from _described(roll)


def _described(roll: _Roll) -> Iterator[pa.RecordBatch]:
    if roll.done:
        yield pa.RecordBatch.from_pylist(roll.done).cast(pa.schema([
            ("shard", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()),
        ]))
        roll.done = []


def repeated_payloads(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, digest, refers_to for the pages whose payload occurs more than once; refers_to is the largest of their ids.

    ``pages`` has page_id, digest and size. Payloads are first counted, so a payload that a third of all pages
    share is one row. A page without an id repeats one with an id, but none repeats it: there is nothing to refer to.
    """
    large = pages.where(F.col("size") >= least_bytes).select("page_id", "digest")
    many = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return large.join(many, "digest").select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str | None = None, settings: Settings = DEFAULT) -> str:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the folder.

    A null html is an empty payload, a null url an empty target. Of pages with equal payloads of at least
    ``least_bytes`` the one with the largest id holds the payload and the others are revisits; of rows that repeat this page, the first.
    Pages without an id come first; they are revisits of a page with an id and the same payload, and responses where there is none. Other columns are not read. No pages give no archive and a manifest.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html"), F.sha1(html.cast("binary")).alias("digest"))
    narrow = stored(keyed.select("page_id", "digest", F.octet_length(html).cast("long").alias("size")), "payloads")
    bounds, parts = shard_bounds(narrow.select("page_id", F.col("size") + F.lit(500).alias("size")).toDF("page_id", "size"), settings.shard_bytes)
    lower, split = np.array(bounds, np.int64), np.array(parts, np.int64)
    first = np.concatenate(([0], np.cumsum(split)))

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        own = np.nan_to_num(ids.fill_null(int(lower[0])).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = np.maximum(np.searchsorted(lower, own, "right") - 1, 0)
        part = (hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.int64) * split[at] >> 32
        return pa.array((first[at] + part).astype(np.int32))

    said = repeated_payloads(narrow, settings.least_bytes)
    rows = keyed.withColumn("is_page", F.lit(True)).withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        said.withColumn("is_page", F.lit(False)), allowMissingColumns=True
    )
    ordered = (
        rows.withColumn("shard", shard_of("page_id", F.xxhash64("digest")))
        .repartitionById(int(first[-1]), F.col("shard"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "is_page", "url")
        .select("shard", "page_id", "digest", "is_page", "url", "html", "refers_to")
    )
    files = [r.asDict() for r in ordered.mapInArrow(lambda b: _write(b, folder, settings), _FILE).collect()]
    files.sort(key=lambda f: f["name"])
    moves = [(f.pop("temporary"), f["name"]) for f in files]
    total = sum(f["records"] for f in files)
    commit(folder, moves, json.dumps({"records": total, "files": files}, sort_keys=True).encode())
    return folder


# reading


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(_READ)
            if not data:
                break
        out.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends inside a record")


def _parsed(member: bytes) -> tuple[dict[bytes, bytes], bytes]:
    head, _, rest = member.partition(_CRLF + _CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(_CRLF)[1:])
    return fields, rest[: int(fields[b"Content-Length"])]


_PAGE = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("html", pa.binary()),
])


def _page(member: bytes) -> dict | None:
    fields, block = _parsed(member)
    kind = fields[b"WARC-Type"]
    if kind not in (b"response", b"revisit"):
        return None
    if fields[b"WARC-Block-Digest"] != _sha1(block):
        raise ValueError(f"damaged record {fields[b'WARC-Record-ID'].decode()}")
    payload = block.partition(_CRLF + _CRLF)[2]
    if kind == b"response" and (fields[b"WARC-Payload-Digest"] != _sha1(payload) or int(fields[b"X-Payload-Length"]) != len(payload)):
        raise ValueError(f"damaged payload {fields[b'WARC-Record-ID'].decode()}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number(b"X-Page-ID"),
        "payload_bytes": number(b"X-Payload-Length"),
        "payload_digest": base64.b32decode(fields[b"WARC-Payload-Digest"][5:]).hex(),
        "record_type": kind.decode(),
        "refers_to": number(b"X-Refers-To-Page-ID"),
        "url": fields[b"WARC-Target-URI"].decode(),
        "html": payload if kind == b"response" else None,
    }


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record of the files that the manifest names: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url,
    html (the payload; null for revisits). Digests are checked. One task reads a file."""
    store, root = open_store(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        names = [(x["name"],) for x in json.loads(f.read())["files"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                rows, size = [], 0
                for member in _members(f):
                    row = _page(member)
                    if row is not None:
                        rows.append(row)
                        size += len(row["html"] or b"") + 100
                    if size > _READ:
                        yield pa.RecordBatch.from_pylist(rows, _PAGE)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PAGE)

    files = spark.createDataFrame(names, "name string").repartition(max(1, len(names)))
    return files.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html binary"
    )
