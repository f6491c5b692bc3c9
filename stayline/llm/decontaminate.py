"""Benchmark passages in documents, a few word edits aside: pigeonhole pieces and bit-parallel distance.

A test item of n words may be altered in k words (inserted, deleted or replaced). Cut into k + 1 pieces, at
least one piece must occur unaltered, so an exact search for all pieces finds every place worth
checking, and the distance of the item to the text around it is then computed word-wise with Myers'
bit vectors. Words are runs of letters, digits and underscores in lower case, so case, punctuation and line breaks
do not hide a passage; in scripts written without blanks every character is a word. A short item has no budget: it is one piece,
which must occur as it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import slices, stored

# Scripts written without blanks between words (Thai to Tibetan, Myanmar, Khmer, kana, Han and its extensions).
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")


@dataclass(frozen=True)
class Settings:
    """``budget_percent`` of an item's words may be altered, rounded down, but none of an item with fewer than ``altered_words``
    words. Items with fewer than ``least_words`` words are not looked for: by default every item with a word is. A pass over the documents looks for items of ``pass_bytes``
    together; more items take more passes. Documents are searched in runs of ``run_bytes``."""

    budget_percent: int = 20
    altered_words: int = 8
    least_words: int = 1
    pass_bytes: int = 4 << 20
    run_bytes: int = 4 << 20


DEFAULT = Settings()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """``words`` cut into ``budget`` + 1 pieces of nearly equal length, each with its place."""
    n, count = len(words), budget + 1
    cuts = [n * i // count for i in range(count + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def least_distance(item: list[str], text: list[str], masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Fewest word edits between ``item`` and any stretch of ``text``, and where the first such stretch ends.

    Myers' algorithm for approximate matching, one integer for a column of the distance matrix.
    """
    size = len(item)
    if masks is None:
        masks = bit_masks(item)
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, place = size, 0
    for at, word in enumerate(text):
        same = masks.get(word, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus) & full, plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, place = score, at + 1
    return best, place


def bit_masks(item: list[str]) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for place, word in enumerate(item):
        masks[word] |= 1 << place
    return dict(masks)


class Searcher:
    """Finds the items of one pass in a text."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.items, self.found_in = [], defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(1, settings.least_words):
                continue
            budget = len(words) * settings.budget_percent // 100 if len(words) >= settings.altered_words else 0
            for start, piece in pieces(words, budget):
                self.found_in[f" {' '.join(piece)} "].append((len(self.items), start, len(piece)))
            self.items.append((item_id, words, budget, bit_masks(words)))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for key in self.found_in:
            self.automaton.add_word(key, key)
        if self.found_in:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, words of the item, word of the text behind the passage), one for each item found."""
        words = words_of(text)
        if not words or not self.items:
            return []
        line = f" {' '.join(words)} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        seen_to = seen_words = 0
        for end, key in self.automaton.iter(line):
            seen_words += line.count(" ", seen_to, end)
            seen_to = end
            # `end` is the blank behind the piece's last word
            for item, start, length in self.found_in[key]:
                size, budget = len(self.items[item][1]), self.items[item][2]
                first = seen_words - length - start
                windows[item].append((max(0, first - budget), first + size + budget))
        out = []
        for item, spans in windows.items():
            item_id, own, budget, masks = self.items[item]
            best = (budget + 1, 0)
            for a, b in _merged(spans):
                distance, place = least_distance(own, words[a:b], masks)
                best = min(best, (distance, a + place))
            if best[0] <= budget:
                out.append((item_id, best[0], budget, len(own), best[1]))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_MATCH = "item_id long, distance int, budget int, item_words int, end_word int"


def _search(docs: DataFrame, items: list[tuple[int, str]], settings: Settings, names: list[str], schema: str) -> DataFrame:
    """``docs`` (text first, then ``names``) with one row for each match."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items, settings)
        for batch in slices(batches, 0, settings.run_bytes):
            rows, hits = [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                for hit in searcher.matches(text):
                    rows.append(row)
                    hits.append(hit)
            if rows:
                own = [batch.column(name).take(pa.array(rows)) for name in names]
                found = [pa.array(values, kind) for values, kind in zip(zip(*hits), [pa.int64()] + [pa.int32()] * 4)]
                yield pa.RecordBatch.from_arrays(own + found, [*names, "item_id", "distance", "budget", "item_words", "end_word"])

    return docs.mapInArrow(find, f"{schema}, {_MATCH}")


def _passes(items: DataFrame, settings: Settings) -> Iterator[list[tuple[int, str]]]:
    """The items in runs of about ``pass_bytes``; only one run is on the driver at a time."""
    run, size = [], 0
    for row in items.toLocalIterator():
        run.append((row["item_id"], row["text"]))
        size += len(row["text"].encode())
        if size >= settings.pass_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = DEFAULT, text: str = "text", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row for each document and test item of which the document holds a passage within the item's budget.

    Columns: ``keys`` of the document, item_id, distance (word edits of the nearest passage), budget, item_words and
    end_word (words of the document up to the passage's end). Null and empty texts hold nothing; null items are
    skipped, items of the same text each give rows of their own. Other columns are not read. Names in ``keys`` must
    differ from the result's own.
    """
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    narrow = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{k}`") for k in keys])
    given = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    out = None
    for run in _passes(given, settings):
        found = _search(narrow, run, settings, list(keys), schema)
        out = found if out is None else out.unionAll(found)
    return _search(narrow, [], settings, list(keys), schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = DEFAULT, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of a test item. Rows are told apart by hashes of all
    that is compared, the text, so rows with equal texts share their fate."""
    hashes = [F.xxhash64(F.col(f"`{text}`")).alias("_h1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("_h2")]
    keyed = docs.select(F.col(f"`{text}`").alias("text"), *hashes)
    bad = stored(find_leaks(keyed, benchmark, settings, "text", ("_h1", "_h2")).select("_h1", "_h2").distinct(), "leaks")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *hashes)
    return packed.join(bad, ["_h1", "_h2"], "left_anti").select("doc.*")
