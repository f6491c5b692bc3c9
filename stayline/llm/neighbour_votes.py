"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of terms: pairs of neighbouring character classes, words by hash, and repetitions. Terms are weighted by their rarity
in the whole corpus and projected on the leading singular vectors of a labelled sample. The labelled vectors are of fixed
size and sent to every task, where each run of documents meets all of them in one exact product; the nearest vote,
weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.llm.storage import slices, stored

#: Text bytes and rows of one run of documents in a task; a longer document is read in stretches of so many bytes.
RUN_BYTES, RUN_ROWS = 1 << 20, 512

# character classes of UTF-8 bytes: a small letter or mark each its own, capitals, digits, blanks, bytes above 127, others
_OWN = [*range(ord("a"), ord("z") + 1), *b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ord(" "), ord("\n")]
_CLASS = np.zeros(256, np.int64)
_CLASS[_OWN] = np.arange(1, len(_OWN) + 1)
_CLASS[ord("A") : ord("Z") + 1] = len(_OWN) + 1
_CLASS[ord("0") : ord("9") + 1] = len(_OWN) + 2
_CLASS[128:] = len(_OWN) + 3
_EDGE = len(_OWN) + 4
CLASSES = _EDGE + 1

#: The terms: class pairs, word buckets, and how often a word repeats the one before it or the one before that, three words or a line
#: repeat earlier ones of the document.
PAIRS, WORDS = CLASSES * CLASSES, 1024
REPEATS = ("word", "second_word", "three_words", "line")
TERMS = PAIRS + WORDS + len(REPEATS)

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents of each class at most; with ``dimensions`` it bounds what is collected and broadcast."""

    sample: int = 2048
    dimensions: int = 32
    neighbours: int = 15
    power: int = 8
    seed: int = 1


@lru_cache(4)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    return _all_powers(base, 1 << n.bit_length())[:n]


class _Stretch:
    """Hashes of any span of a run of bytes, from running sums of a polynomial modulo 2^64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def _spans(inside: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; no run goes across a head."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(last) + 1


def _again(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows of the hashes that the same row has had before."""
    with np.errstate(over="ignore"):
        keys = hashes * np.uint64(0xD6E8FEB86659FD93) + row.astype(np.uint64) * np.uint64(_BASE)
    order = np.argsort(keys)
    row, keys = row[order], keys[order]
    return row[1:][keys[1:] == keys[:-1]]


def _add_stretch(counts: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Add the terms of the texts in ``raw`` to ``counts`` (rows by terms); text i lies at offsets[i] to offsets[i + 1]."""
    rows = np.arange(len(offsets) - 1)
    filled = rows[offsets[:-1] < offsets[1:]]
    heads = offsets[:-1][filled]
    row = np.repeat(rows, np.diff(offsets))
    kind = _CLASS[raw]
    before = np.empty_like(kind)
    before[1:], before[heads] = kind[:-1], _EDGE
    cell = row * TERMS + before * CLASSES + kind
    ends = filled * TERMS + kind[offsets[1:][filled] - 1] * CLASSES + _EDGE
    text = _Stretch(raw)
    starts, stops = _spans(~_BLANK[raw], heads)
    word, in_row = text.of(starts, stops), row[starts]
    bucket = ((word * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(54)).astype(np.int64)
    repeats = [in_row[d:][(word[d:] == word[:-d]) & (in_row[d:] == in_row[:-d])] for d in (1, 2)]
    with np.errstate(over="ignore"):
        three = (word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(5) + word[2:]
    together = in_row[2:] == in_row[:-2]
    repeats.append(_again(in_row[2:][together], three[together]))
    lines, line_ends = _spans(raw != ord("\n"), heads)
    repeats.append(_again(row[lines], text.of(lines, line_ends)))
    cells = [cell, ends, in_row * TERMS + PAIRS + bucket, *[r * TERMS + PAIRS + WORDS + k for k, r in enumerate(repeats)]]
    counts += np.bincount(np.concatenate(cells), minlength=counts.size).reshape(counts.shape)


def term_counts(texts: pa.Array) -> np.ndarray:
    """How often each text holds each term, a row for each text; nulls have none."""
    counts = np.zeros((len(texts), TERMS), np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    # an empty text is a pair of edges
    counts[offsets[:-1] == offsets[1:], _EDGE * CLASSES + _EDGE] = 1
    start = 0
    while start < len(raw):
        stop = min(len(raw), start + 2 * RUN_BYTES)
        if stop < len(raw):
            blank = np.flatnonzero(_BLANK[raw[start:stop]])
            stop = start + int(blank[-1]) + 1 if len(blank) else stop
        _add_stretch(counts, raw[start:stop], np.clip(offsets, start, stop) - start)
        start = stop
    return counts * texts.is_valid().to_numpy(zero_copy_only=False)[:, None]


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column, RUN_BYTES):
        for at in range(0, batch.num_rows, RUN_ROWS):
            yield batch.slice(at, RUN_ROWS)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and for each term the number that hold it, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(TERMS, np.int64), 0
        for batch in _runs(batches, 0):
            found += np.count_nonzero(term_counts(batch.column(0)), axis=0)
            n += batch.num_rows
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(found[held], n))], ["term", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out, n = np.zeros(TERMS, np.int64), 0
    for r in rows.collect():  # one row for each term
        if r["term"] < 0:
            n = r["n"]
        else:
            out[r["term"]] = r["n"]
    return n, out


@dataclass(frozen=True)
class Space:
    """Term weights and the leading singular vectors."""

    rarity: np.ndarray
    axes: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.rarity) @ self.axes)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    out = np.zeros(counts.shape, np.float32)
    np.log(counts, out=out, where=counts > 0)
    out[counts > 0] += 1
    return _unit(out * rarity)


def singular_axes(rows: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a seeded start."""
    width = min(dimensions + 16, *rows.shape)
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(6):
        left, _ = np.linalg.qr(rows @ basis)
        basis, _ = np.linalg.qr(rows.T @ left)
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ right.T)[:, :dimensions])


@dataclass(frozen=True)
class Voters:
    """The labelled vectors: what is broadcast. ``weight`` is the number of labelled documents that each stands for."""

    space: Space
    vectors: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    neighbours: int
    power: int

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, and all as near as the last of them, by similarity and weight."""
        if not len(self.label):
            return np.full(len(counts), 0.5)
        near = np.maximum(self.space.vectors(counts) @ self.vectors.T, 0)
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        votes = np.where(near >= last[:, None], near, 0).astype(np.float64) ** self.power * self.weight
        total = votes.sum(axis=1)
        usual = float((self.weight * self.label).sum() / self.weight.sum())
        return np.divide(votes @ self.label, total, out=np.full(len(counts), usual), where=total > 0)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is set aside for testing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_ids(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, label, draw): the documents to learn from; ids whose labels contradict each other are left out."""
    told = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most"))
        .where("label = most")
    )
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).join(told.select("doc_id"), "doc_id", "left_semi").distinct()
    return told.join(known, "doc_id").select("doc_id", "label", F.xxhash64(F.lit("draw"), "doc_id").alias("draw"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """Learn from at most ``sample`` documents of each class, those with the lowest hashes; rarity is that of all documents."""
    known = stored(labelled_ids(docs, labels, doc_id, label), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # half as many again pass the hash, so that few are left to order
    share = {c: min(1.0, 1.5 * settings.sample / n) for c, n in sizes.items()}
    chosen = None
    for c, part in sorted(share.items()):
        low = F.col("draw") < F.lit(int(-(2**63) + part * (2**64 - 2048)))
        few = known.where((F.col("label") == c) & (low | F.lit(part == 1.0))).orderBy("draw", "doc_id").limit(settings.sample)
        chosen = few if chosen is None else chosen.unionByName(few)
    n, frequency = document_frequencies(docs, text)
    rarity = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    if chosen is None:
        nothing = np.zeros((0, settings.dimensions), np.float32)
        return Voters(Space(rarity, np.zeros((TERMS, settings.dimensions), np.float32)), nothing, np.zeros(0), np.zeros(0), settings.neighbours, settings.power)
    # an id that stands for several documents is learnt from one of them
    texts = (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        .join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2):
            counts = term_counts(batch.column(2))
            held = [np.flatnonzero(row) for row in counts]
            terms = pa.array([at.astype(np.int32).tobytes() for at in held], pa.binary())
            times = pa.array([row[at].astype(np.int32).tobytes() for row, at in zip(counts, held)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, times], ["doc_id", "label", "terms", "times"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = sorted(texts.mapInArrow(run, f"doc_id {kind}, label int, terms binary, times binary").collect(), key=lambda r: r["doc_id"])
    counts = np.zeros((len(rows), TERMS), np.int32)
    for at, r in enumerate(rows):
        counts[at, np.frombuffer(r["terms"], np.int32)] = np.frombuffer(r["times"], np.int32)
    space = Space(rarity, singular_axes(_weighted(counts, rarity), settings.dimensions, settings.seed))
    target = np.array([r["label"] for r in rows], np.float64)
    stands_for = {c: sizes[c] / max(1, np.count_nonzero(target == c)) for c in sizes}
    weight = np.array([stands_for[c] for c in target])
    return Voters(space, space.vectors(counts), target, weight, settings.neighbours, settings.power)


def score(docs: DataFrame, voters: Voters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1, six decimals) and predicted (1 from 0.5); columns of these names are replaced. No shuffle.

    A null or empty text has no terms but its edges; where nothing in the sample resembles a text at all, its score is the share of
    label 1 among the labelled documents, and 0.5 without any labels. Repeated rows get equal scores. A null id is not held out. Texts are
    read whole, a longer one than ``RUN_BYTES`` in stretches cut at blanks.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    asked = docs.select(*own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("\0text"))
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("score", T.DoubleType())])
    sent, at = docs.sparkSession.sparkContext.broadcast(voters), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, at):
            found = np.round(sent.value.scores(term_counts(batch.column(at))), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], schema.names)

    scored = asked.mapInArrow(run, schema)
    return scored.select(
        *own, held_out(F.col(f"`{doc_id}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``fit`` and ``score`` in one."""
    return score(docs, fit(docs, labels, settings))
