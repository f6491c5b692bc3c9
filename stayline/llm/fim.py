"""Fill-in-middle rearrangement on a piece table.

A document is never edited. It is a list of descriptors (buffer, start, length) over two immutable buffers: its own
UTF-8 bytes and the bytes of the three sentinels. Cutting splits a descriptor, an arrangement is a permutation of
descriptors, its inverse restores the document, and digests run over the descriptors' bytes without joining them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.storage import slices

TEXT, SENTINELS = 0, 1
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Places of prefix, middle, suffix and the sentinels <P>, <S>, <M> in the undisturbed list of pieces.
PREFIX, MIDDLE, SUFFIX, BEFORE_PREFIX, BEFORE_SUFFIX, BEFORE_MIDDLE = range(6)
ARRANGEMENTS = {
    PSM: (BEFORE_PREFIX, PREFIX, BEFORE_SUFFIX, SUFFIX, BEFORE_MIDDLE, MIDDLE),
    SPM: (BEFORE_SUFFIX, SUFFIX, BEFORE_PREFIX, PREFIX, BEFORE_MIDDLE, MIDDLE),
}

#: Text bytes of one run of rows in a task.
RUN_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """Which documents are rearranged, and how; ``seed`` is part of every draw."""

    seed: int = 1
    rearranged_percent: int = 90
    spm_percent: int = 20
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self) -> None:
        marks = self.sentinels
        # a mark that no other text or mark can overlap is found again wherever it was put
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] != marks[0][0] for m in marks):
            raise ValueError("sentinels must differ, share their first character and hold it only there")


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


@dataclass(frozen=True)
class PieceTable:
    """Descriptors over immutable buffers."""

    buffers: tuple[memoryview, ...]
    pieces: tuple[Piece, ...]

    def cut(self, at: Sequence[int]) -> PieceTable:
        """Split the descriptors at offsets (ascending) of the document; empty pieces are kept."""
        out: list[Piece] = []
        cuts, offset = list(at), 0
        for piece in self.pieces:
            start, end = piece.start, piece.start + piece.length
            while cuts and cuts[0] <= offset + piece.length:
                middle = piece.start + cuts.pop(0) - offset
                out.append(replace(piece, start=start, length=middle - start))
                start = middle
            out.append(replace(piece, start=start, length=end - start))
            offset += piece.length
        return replace(self, pieces=tuple(out))

    def plus(self, pieces: Sequence[Piece]) -> PieceTable:
        return replace(self, pieces=(*self.pieces, *pieces))

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return replace(self, pieces=tuple(self.pieces[i] for i in order))

    def restored(self, order: Sequence[int]) -> PieceTable:
        """The inverse of ``arranged``."""
        return self.arranged(np.argsort(order).tolist())

    def first(self, n: int) -> PieceTable:
        return replace(self, pieces=self.pieces[:n])

    def views(self) -> Iterator[memoryview]:
        for piece in self.pieces:
            yield self.buffers[piece.buffer][piece.start : piece.start + piece.length]

    def digest(self) -> str:
        state = hashlib.sha256()
        for view in self.views():
            state.update(view)
        return state.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.views())


def whole(data: bytes | memoryview, *others: bytes) -> PieceTable:
    view = memoryview(data)
    return PieceTable((view, *map(memoryview, others)), (Piece(TEXT, 0, len(view)),))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def unit_starts(data: memoryview) -> np.ndarray:
    """Byte offsets at which a unit begins: a run of ASCII letters, or one other code point."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    begins = (raw & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def _chars(data: memoryview) -> int:
    """Code points of UTF-8 bytes: those that do not continue another."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def cuts_of(data: memoryview, starts: np.ndarray, draws: tuple[int, int]) -> tuple[int, int]:
    """Byte offsets of both cuts: each draw modulo (units + 1) is a number of units, the smaller first."""
    n = len(starts)
    ends = [*sorted(draw % (n + 1) for draw in draws)]
    return tuple(int(starts[k]) if k < n else len(data) for k in ends)


def rearranged(data: bytes | memoryview, drawn: str, draws: tuple[int, int], marks: tuple[bytes, bytes, bytes]) -> tuple[int, str, PieceTable]:
    """Units of the text, the form it takes, and its pieces in that form."""
    table = whole(data, b"".join(marks))
    view = table.buffers[TEXT]
    starts = unit_starts(view)
    raw = bytes(view)
    if drawn == PLAIN or not len(view) or any(mark in raw for mark in marks):
        return len(starts), PLAIN, table
    ends = np.cumsum([len(mark) for mark in marks])
    sentinels = [Piece(SENTINELS, int(end) - len(mark), len(mark)) for end, mark in zip(ends, marks)]
    return len(starts), drawn, table.cut(cuts_of(view, starts, draws)).plus(sentinels).arranged(ARRANGEMENTS[drawn])


def restored(output: bytes | memoryview, form: str, marks: tuple[bytes, bytes, bytes]) -> PieceTable:
    """The original document as pieces of the output."""
    table = whole(output)
    if form == PLAIN:
        return table
    order = ARRANGEMENTS[form]
    raw = bytes(table.buffers[TEXT])
    cuts, at = [], 0
    for place in order[::2]:
        mark = marks[place - BEFORE_PREFIX]
        at = raw.index(mark, at)
        cuts += [at, at + len(mark)] if at else [len(mark)]
    return table.cut(cuts).restored(order).first(SUFFIX + 1)


PIECES = "array<struct<buffer:int,start:bigint,length:bigint>>"
_ADDED = f"n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {PIECES}, output string, output_sha256 string"


def _fields(schema: str) -> list[T.StructField]:
    return T.StructType.fromDDL(schema).fields


def _text(values: list[bytes | None]) -> pa.Array:
    # Spark strings are bytes; they are passed on as they came
    return pa.array(values, pa.binary()).view(pa.string())


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each string; null: empty."""
    for value in column.cast(pa.binary()):
        yield memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def _draws(key: Column, settings: Settings) -> list[Column]:
    """Four numbers from the first 32 hex digits of sha256 of ``seed:key``."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digits = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_chars, middle_chars, pieces, output and output_sha256.

    A unit is a run of ASCII letters or one other code point. ``pieces`` are the descriptors in output order: buffer 0 is the
    text, 1 the sentinels, start and length in bytes. ``output`` is what they spell, output_sha256 its digest. Columns of ``docs``
    that bear one of these names are replaced. The draws depend on the seed and the key alone, so rows that repeat a key and a
    text get the same result; a null key draws as an empty one. A null or empty text is plain with n 0 and an empty output, and
    so is, unchanged, a text that holds a sentinel; plain rows have no prefix_chars and middle_chars. Texts are taken whole. No shuffle.
    """
    marks = tuple(mark.encode() for mark in settings.sentinels)
    added = _fields(_ADDED)
    names = {f.name for f in added}
    kept = [c for c in docs.columns if c not in names]
    first, second, third, fourth = _draws(F.col(f"`{key}`"), settings)
    drawn = (
        F.when(third % 100 >= settings.rearranged_percent, PLAIN).when(fourth % 100 < settings.spm_percent, SPM).otherwise(PSM)
    )
    own = [F.col(f"`{c}`") for c in kept]
    asked = docs.select(*own, F.struct(first.alias("a"), second.alias("b"), drawn.alias("drawn"), F.col(f"`{text}`").alias("text")).alias("\0ask"))
    schema = T.StructType([*docs.select(*own).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            ask = batch.column(batch.num_columns - 1)
            a, b, forms = (ask.field(i).to_pylist() for i in range(3))
            rows = [rearranged(*each, marks) for each in zip(_views(ask.field(3)), forms, zip(a, b))]
            by_form = {form: np.argsort(order) for form, order in ARRANGEMENTS.items()}

            def chars(row: tuple[int, str, PieceTable], place: int) -> int | None:
                _, form, table = row
                if form == PLAIN:
                    return None
                piece = table.pieces[by_form[form][place]]
                return _chars(table.buffers[TEXT][piece.start : piece.start + piece.length])

            described = [[{"buffer": p.buffer, "start": p.start, "length": p.length} for p in t.pieces] for _, _, t in rows]
            columns = [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([form for _, form, _ in rows], pa.string()),
                pa.array([chars(row, PREFIX) for row in rows], pa.int64()),
                pa.array([chars(row, MIDDLE) for row in rows], pa.int64()),
                pa.array(described, pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))),
                _text([t.content() for _, _, t in rows]),
                pa.array([t.digest() for _, _, t in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return asked.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of about ``RUN_BYTES`` of the text in their last column (a struct that ends with it)."""
    for batch in batches:
        ask = batch.column(batch.num_columns - 1)
        texts = pa.RecordBatch.from_arrays([ask.field(ask.type.num_fields - 1)], ["text"])
        at = 0
        for run in slices(iter([texts]), 0, RUN_BYTES):
            yield batch.slice(at, run.num_rows)
            at += run.num_rows


def restore(rows: DataFrame, settings: Settings = Settings(), output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with restored (the original text, from output and form alone) and restored_sha256.

    Columns of these names are replaced. A null output counts as an empty one, a null form as plain. An output that does not
    hold the sentinels of its form was not made by ``rearrange`` and stops the job.
    """
    marks = tuple(mark.encode() for mark in settings.sentinels)
    added = _fields("restored string, restored_sha256 string")
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("restored", "restored_sha256")]
    kind = F.coalesce(F.col(f"`{form}`"), F.lit(PLAIN)).alias("form")
    asked = rows.select(*own, F.struct(kind, F.col(f"`{output}`").alias("text")).alias("\0ask"))
    schema = T.StructType([*rows.select(*own).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            ask = batch.column(batch.num_columns - 1)
            tables = [restored(view, form, marks) for view, form in zip(_views(ask.field(1)), ask.field(0).to_pylist())]
            columns = [_text([t.content() for t in tables]), pa.array([t.digest() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    return asked.mapInArrow(run, schema)
