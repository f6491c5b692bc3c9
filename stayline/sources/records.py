"""CSV records that may hold line breaks inside quotes, read by many tasks.

A task that starts in the middle of a file cannot tell whether it starts inside quotes. It reads its lines under both
assumptions at once: what it then knows is where either would end, one row for each split of a file. Put together in file order, these rows tell how
each split really starts, and a second pass cuts the records. A record that reaches over splits is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import durable, small_table

# one complete record in one line: cells without a quote in front, or quoted ones that are closed
_CELL = r'(?:[^",][^,]*+|"[^"]*+(?:""[^"]*+)*+"[^,]*+)?+'
_COMPLETE = rf"^{_CELL}(?:,{_CELL})*+$"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside quotes, or at a cell, ends inside quotes.

    A quote opens a cell only as its first character, and two of them inside stand for one.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


class _Assumed:
    """A split read under one assumption about how it starts."""

    def __init__(self, inside: bool):
        self.inside = inside
        # pieces of a record of an earlier split, and whether it ended here
        self.head: list[str] | None = [] if inside else None
        self.head_ended = False
        self.open: list[str] = []

    def read(self, line: str) -> str | None:
        """Take a line; a record that it completes comes back, unless it began in an earlier split."""
        self.inside = ends_inside(line, self.inside)
        if self.head is not None and not self.head_ended:
            self.head.append(line)
            self.head_ended = not self.inside
            return None
        self.open.append(line)
        if self.inside:
            return None
        record, self.open = "\n".join(self.open), []
        return record


_SPLITS = "file bigint, block bigint, out_inside boolean, in_inside boolean, head string, head_ended boolean, out_tail string, in_tail string"


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, bool], str]]:
    """Lines with their file, split, and the last column; lines of a split come one after the other."""
    for batch in batches:
        yield from zip(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))), batch.column(0).to_pylist())


def _assumptions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(at: tuple, out: _Assumed, into: _Assumed) -> pa.RecordBatch:
        text = lambda lines: "\n".join(lines) if lines else None
        values = [at[0], at[1], out.inside, into.inside, "\n".join(into.head or []), into.head_ended, text(out.open), text(into.open)]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)], [part.split()[0] for part in _SPLITS.split(", ")]
        )

    now, out, into = None, None, None
    for at, line in _by_split(batches):
        if at != now:
            if now is not None:
                yield row(now, out, into)
            now, out, into = at, _Assumed(False), _Assumed(True)
        out.read(line)
        into.read(line)
    if now is not None:
        yield row(now, out, into)


def _starts(splits: list) -> list[tuple[int, int, bool, int | None]]:
    """(file, block, inside, owner): how each split starts, and in which split the record began that it goes on with."""
    rows = []
    file, inside, owner = None, False, None
    for s in sorted(splits, key=lambda s: (s["file"], s["block"])):
        if s["file"] != file:
            file, inside, owner = s["file"], False, None
        rows.append((s["file"], s["block"], inside, owner))
        if inside and not s["head_ended"]:
            continue
        inside = s["in_inside"] if inside else s["out_inside"]
        owner = s["block"] if inside else None
    return rows


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie within a split, the first one of a file left out: its header."""
    now, split, header, held, size = None, None, False, [], 0
    for at, line in _by_split(batches):
        if at != now:
            now, split, header = at, _Assumed(at[2]), at[1] == 0
        record = split.read(line)
        if record is None or not record.strip():
            continue
        if header:
            header = False
            continue
        held.append(record.removesuffix("\r"))
        size += len(record)
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["record"])
            held, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["record"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(place["file_path"]).alias("file"), place["file_block_start"].alias("block"), F.lit(None).cast("boolean").alias("inside")
    )


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line is not a whole number of records: found without Python, in one narrow pass."""
    line = F.regexp_replace("value", "\r$", "")
    broken = F.col("value").contains('"') & ~line.rlike(_COMPLETE)
    return bool(_lines(spark, path).where(broken).limit(1).count())


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record of the CSV files at ``path`` but the header of each, line breaks inside quotes kept.

    Blank lines between records are left out. A quote that is never closed makes all the rest of its file one record. What
    reaches the driver is one row of a few numbers for each split of a file, and as many rows are sent to the tasks.
    """
    lines = _lines(spark, path)
    splits = durable(lines.mapInArrow(_assumptions, _SPLITS), "csv-splits")
    starts = _starts(splits.select("file", "block", "out_inside", "in_inside", "head_ended").collect())
    known = F.broadcast(small_table(spark, starts, "file bigint, block bigint, starts_inside boolean, owner bigint"))
    within = lines.join(known, ["file", "block"]).select("value", "file", "block", "starts_inside").mapInArrow(_records, "record string")
    ends_open = F.when(F.col("starts_inside"), F.col("in_tail")).otherwise(F.col("out_tail"))

    def piece(owner: Column, text: Column) -> Column:
        return F.struct(owner.alias("owner"), F.col("block"), text.alias("text"))

    pieces = F.array(
        F.when(F.col("starts_inside"), piece(F.col("owner"), F.col("head"))),
        F.when(ends_open.isNotNull() & (~F.col("starts_inside") | F.col("head_ended")), piece(F.col("block"), ends_open)),
    )
    over = (
        splits.join(known, ["file", "block"])
        .select("file", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("piece"))
        .select("file", "piece.*")
        .groupBy("file", "owner")
        # the splits that one record reaches over
        .agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select(F.regexp_replace(F.array_join(F.col("parts.text"), "\n"), "\r$", "").alias("record"))
    )
    return within.unionByName(over)


def parsed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The cells of each record as text, by Spark's own parser; missing ones are null."""
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    return rows.select(F.from_csv("record", schema, {"escape": '"', "multiLine": "true"}).alias("cells")).select("cells.*")
