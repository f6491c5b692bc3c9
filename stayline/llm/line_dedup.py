"""Lines that repeat an earlier line, one word edit aside, by deletion neighbourhoods.

Two lines are within one word edit (a word replaced, inserted or deleted) exactly if they are equal, or equal once the word at the
same place is left out of both, or one is the other with one word left out. So every line is written as all its variants with one word left
out, hashed; variants with their place meet for replacements, variants meet whole lines for insertions. Among
lines that share a variant each compares itself with the earliest only, so a line that stands in a million
versions costs a million rows, not their pairs.

Before variants are written out, lines that cannot have a partner are left aside: of two lines within one edit, either the first or the last half
agrees, so a line none of whose halves occurs in another line has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import numbered, slices, stored

RUN_BYTES = 4 << 20
#: Lines of fewer words are never taken for altered repeats: "Yes." and "No." are one edit apart.
LEAST_WORDS = 5


def _two(data: bytes) -> tuple[int, int]:
    """128 hash bits as two signed longs."""
    value = xxhash.xxh3_128_intdigest(data)
    high, low = value >> 64, value & (1 << 64) - 1
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def _one(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (value >> 63 << 64)


def line_words(line: bytes) -> list[bytes]:
    """Words between white space, A-Z as a-z."""
    return line.lower().split()


def half_keys(words: list[bytes]) -> tuple[int, int, int, int]:
    """Hashes of the halves as a line of this length, and as the longer partner of a line with one word less."""
    out = []
    for n in (len(words), len(words) - 1):
        a = n // 2
        out.append(_one(b"P%d " % n + b" ".join(words[:a])))
        out.append(_one(b"S%d " % n + b" ".join(words[len(words) - (n - a):])))
    return tuple(out)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[first + (len(a) == len(b)):] == b[first + 1:]


_PLACE = "absent boolean, doc_id long, text_hash long, line_no int"
_PLACE_ARROW = [("absent", pa.bool_()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line_no", pa.int32())]


def _lines(docs: DataFrame, least_words: int, more: list[tuple[str, pa.DataType]], sql: str, values) -> DataFrame:
    """A row for each line of at least ``least_words`` words: place, h1, h2 (hash of its words) and ``values(line, words)``."""
    fields = _PLACE_ARROW + [("h1", pa.int64()), ("h2", pa.int64())] + more

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, RUN_BYTES):
            columns: list[list] = [[] for _ in fields]
            for doc_id, text_hash, text in zip(*(batch.column(k).cast(pa.binary() if k == 2 else pa.int64()).to_pylist() for k in range(3))):
                for number, line in enumerate((text or b"").split(b"\n")):
                    words = line_words(line)
                    if len(words) >= least_words:
                        row = (doc_id is None, doc_id, text_hash, number, *_two(b" ".join(words)), *values(line, words))
                        for column, value in zip(columns, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(read, f"{_PLACE}, h1 long, h2 long{sql}")


_VARIANT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.int8()), ("at", pa.int64())])
REPLACED, LONGER, WHOLE = range(3)
#: Odd multipliers of the two running hashes, and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mixed(x: np.ndarray, *tags: np.ndarray | int) -> np.ndarray:
    """Hashes of numbers together with small numbers that tell their kind."""
    with np.errstate(over="ignore"):
        for tag in tags:
            x = (x ^ np.asarray(tag).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(32))
    return x


def _variant_keys(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind and both keys of all variants of lines given by their words.

    A line's hash is the sum of its words' hashes times powers of a base. Without one word it is the sum before the word plus
    the sum behind it, moved down by one power, so a line costs as much as it has words.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
    hashes = np.array([_two(w) for line in words for w in line], np.int64).reshape(-1, 2).view(np.uint64)
    n = np.repeat(sizes, sizes)
    # leaving out either of two equal neighbours gives the same line
    fresh = np.ones(len(row), bool)
    fresh[1:] = (place[1:] == 0) | (hashes[1:] != hashes[:-1]).any(axis=1)
    rows = np.concatenate([np.arange(len(words)), row, row[fresh]])
    kinds = np.repeat(np.array([WHOLE, REPLACED, LONGER], np.int8), [len(words), len(row), int(fresh.sum())])
    keys = []
    for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
        with np.errstate(over="ignore"):
            powers = np.full(int(sizes.max(initial=0)) + 1, base, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, k] * powers[place], dtype=np.uint64)])
            first, last = sums[ends - sizes], sums[ends]
            at = np.arange(len(row))
            rest = (sums[at] - first[row]) + (last[row] - sums[at + 1]) * np.uint64(inverse)
        # a line without a word is looked for among whole lines of that length; others only among lines without the same place
        keys.append(np.concatenate([
            _mixed(last - first, WHOLE, sizes), _mixed(rest, REPLACED + 10, n, place), _mixed(rest[fresh], WHOLE, n[fresh] - 1),
        ]).view(np.int64))
    return rows, kinds, *keys


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All variants of each line (at, line), as hashed keys."""
    for whole in batches:
        for batch in slices(iter([whole]), 1, RUN_BYTES // 16):
            rows, kinds, k1, k2 = _variant_keys([line_words(line) for line in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(kinds), batch.column(0).take(pa.array(rows))], schema=_VARIANT)


_ASKED = "absent boolean, doc_id long, text_hash long, line_no int, h1 long, h2 long, line binary"
_ASKED_ARROW = [*_PLACE_ARROW, ("h1", pa.int64()), ("h2", pa.int64()), ("line", pa.binary())]


def _asked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(absent, doc_id, text_hash, asked: line_no, h1, h2, text) to the asked lines of each text."""
    for batch in slices(batches, 4, RUN_BYTES):
        columns: list[list] = [[] for _ in _ASKED_ARROW]
        texts = batch.column(4).cast(pa.binary()).to_pylist()
        for absent, doc_id, text_hash, asked, text in zip(*(batch.column(k).to_pylist() for k in range(4)), texts):
            lines = (text or b"").split(b"\n")
            for one in asked:
                row = (absent, doc_id, text_hash, one["line_no"], one["h1"], one["h2"], lines[one["line_no"]])
                for column, value in zip(columns, row):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _ASKED_ARROW)], [n for n, _ in _ASKED_ARROW])


def _place() -> Column:
    return F.struct("absent", "doc_id", "text_hash", "line_no")


def _with_possible_partner(uniq: DataFrame) -> DataFrame:
    """h1, h2, first of the lines one of whose half keys occurs in another line."""
    keyed = uniq.select("h1", "h2", "first", F.explode(F.array("p0", "s0", "p1", "s1")).alias("half"))
    shared = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    return keyed.join(shared, "half", "left_semi").select("h1", "h2", "first").distinct()


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, least_equal: int | None = None) -> DataFrame:
    """One row for each line that goes: doc_id, text_hash, line_no, kept_doc_id, kept_line_no, distance.

    A line goes if an earlier line is equal to it (distance 0) or within one word edit (1). Earlier means a smaller doc_id,
    null last, then a smaller hash of the text, then a smaller line number (from 0); the earliest such line is named, an equal one before
    others. A named line may itself go because of a line earlier still. Lines end at line feeds and are compared by their words, A-Z as a-z; lines of
    fewer than ``least_words`` words (2 at least) are not compared for an edit, and of fewer than ``least_equal`` words (``least_words`` if not
    given, 1 at least) not for equality; null and empty texts stay. Rows that repeat id and text count as one. Other columns are not read.
    """
    least_words = max(2, least_words)
    least_equal = least_words if least_equal is None else max(1, least_equal)
    least = min(least_words, least_equal)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    halves = [(k, pa.int64()) for k in ("p0", "s0", "p1", "s1")]
    # words, which equal lines share, counts up to least_words
    kinds = [("words", pa.int32()), *halves]
    every = _lines(
        rows, least, kinds, ", words int, p0 long, s0 long, p1 long, s1 long",
        lambda line, words: (min(len(words), max(least_words, least_equal)), *(half_keys(words) if len(words) >= least_words else (None,) * 4)),
    )
    # split and hashed once; what follows reads the columns it needs
    every = stored(every, "all_lines")
    uniq = stored(
        every.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), *[F.min(k).alias(k) for k, _ in kinds]), "lines"
    )

    possible = stored(_with_possible_partner(uniq.where(F.col("words") >= least_words)), "possible")
    # the texts of the documents that hold the first of such lines; as many as a document has lines are asked of it
    own = (F.col("absent"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("known"), F.col("text_hash"))
    asked = possible.select("first.*", "h1", "h2").groupBy(*own).agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("asked"))
    held = rows.withColumn("absent", F.col("doc_id").isNull()).select("doc_id", "text", *own).join(asked, ["absent", "known", "text_hash"])
    found = held.select("absent", "doc_id", "text_hash", "asked", "text").mapInArrow(_asked_lines, _ASKED)
    # from here on a line is its number in the order of places: earlier is smaller
    order = [F.col(c).asc_nulls_first() for c in ("absent", "doc_id", "text_hash", "line_no")]
    lines, _ = numbered(found.dropDuplicates(["h1", "h2"]).drop("h1", "h2"), *order, name="at")

    variants = stored(lines.select("at", "line").mapInArrow(_variant_rows, "k1 long, k2 long, kind byte, at long"), "variants")
    earliest = variants.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("kind") == WHOLE, F.col("at"))).alias("whole"),
        F.min(F.when(F.col("kind") != WHOLE, F.col("at"))).alias("other"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1")
    partner = F.when(F.col("kind") == LONGER, F.col("whole")).otherwise(F.col("other"))
    pairs = variants.join(earliest, ["k1", "k2"]).select("at", partner.alias("partner")).where("partner < at").distinct()

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([within_one_edit(line_words(a), line_words(b)) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.bool_())

    own = lines.select("at", _place().alias("place"), F.col("line").alias("own"))
    other = lines.select(F.col("at").alias("partner"), _place().alias("kept"), F.col("line").alias("other"))
    verified = pairs.join(own, "at").join(other, "partner").where(near("own", "other"))
    altered = verified.groupBy("at").agg(F.min("place").alias("place"), F.min("kept").alias("kept"), F.lit(1).alias("distance"))

    again = uniq.where((F.col("words") >= least_equal) & ~F.col("first").eqNullSafe(F.col("last"))).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("kept"))
    narrow = every.where(F.col("words") >= least_equal).select("absent", "doc_id", "text_hash", "line_no", "h1", "h2")
    equal = (
        narrow.join(again, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
        .select(_place().alias("place"), "kept", F.lit(0).alias("distance"))
        .where(~F.col("place").eqNullSafe(F.col("kept")))
    )
    return equal.unionByName(altered.select("place", "kept", "distance")).select(
        "place.doc_id", "place.text_hash", "place.line_no",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"), "distance",
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = LEAST_WORDS, least_equal: int | None = None) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; every row stays, if need be with an empty text."""
    gone = repeated_lines(docs, text, doc_id, least_words, least_equal).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "line_no").distinct()
    drops = stored(gone.groupBy("_id", "_hash").agg(F.collect_list("line_no").alias("_drops")), "drops")
    parts = F.split(F.col("_text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drops"))
    cleaned = F.array_join(F.transform(left, lambda i: F.get(F.col("_parts"), i)), "\n")
    own = [F.col(f"doc.`{c}`").alias(c) if c != text else F.coalesce(F.when(F.col("_drops").isNotNull(), cleaned), F.col("_text")).alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("_text"), F.col(f"`{doc_id}`").cast("long").alias("_own"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_hash"))
    return packed.join(drops, same, "left").withColumn("_parts", F.split("_text", "\n")).select(*own)
