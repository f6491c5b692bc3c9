"""How the sources of a language differ in their words, by exact sums over all kept terms.

The count table of a language is a sparse matrix, one row for each source and one column for each term. For every pair of rows
a measure is summed over all columns. As in Gustavson's row-wise product, a row takes its terms one by one through the
term-major index and scatters each posting into a dense accumulator with one cell for each peer, so postings meet without a pair
ever being emitted. Cells that are zero on one side or both are a baseline that follows from the row alone; it is
added for all columns at once and corrected where a posting replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.llm.storage import slices, stored

#: Shares are whole numbers of billionths, so all arithmetic is exact.
SCALE = 1_000_000_000

#: Text bytes of one run of rows in a task, counts that a task holds before it adds them up, counts given out at a time.
RUN_BYTES = 2 << 20
HELD_ROWS = 1_000_000
GIVEN_ROWS = 1 << 16
COUNTED = ["lang", "source", "term", "n", "docs"]

#: Cells of the count matrix in one block, postings scattered at a time.
BLOCK_CELLS = 1 << 19
SCATTERED = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Terms in fewer documents of a language are not kept; ``top_terms`` is the length of the term report."""

    least_docs: int = 3
    top_terms: int = 200


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of all texts in order, with the row of each: runs of ASCII letters and of code points above 127, A-Z lower-cased."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = _LETTER[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    # a text that begins with a letter begins a term, whatever the text before ends with
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = letter[heads]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(offsets, starts, side="right") - 1
    places = np.append(np.cumsum(letter, dtype=np.int64)[starts] - 1, np.count_nonzero(letter)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(_LOWER[raw[letter]].tobytes())])
    return row, found


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their values and how many rows each has."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values, first) if len(keys) else values
    return keys[first], sums, np.diff(np.append(first, len(keys)))


def _of_run(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, text) to (lang, source, term, n, docs), added up; a row without a term for each group."""
    lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    pairs, group = np.unique(pair, return_inverse=True)
    lang_of, source_of = (pa.array(part, pa.int32()) for part in np.divmod(pairs, len(source.dictionary)))
    row, found = terms_of(batch.column(2))
    coded = found.dictionary_encode()
    size = max(1, len(coded.dictionary))
    cells, n, _ = _totals(row * size + coded.indices.to_numpy(), np.ones(len(row), np.int64))
    in_doc, term = np.divmod(cells, size)
    keys, n, docs = _totals(group[in_doc] * size + term, n)
    in_group, term = np.divmod(keys, size)
    groups = np.concatenate([in_group, np.arange(len(pairs))])
    names = pa.concat_arrays([coded.dictionary.take(pa.array(term)).view(pa.string()), pa.nulls(len(pairs), pa.string())])
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(lang_of.take(pa.array(groups))),
            source.dictionary.take(source_of.take(pa.array(groups))),
            names,
            pa.array(np.concatenate([n, np.zeros(len(pairs), np.int64)])),
            pa.array(np.concatenate([docs, np.zeros(len(pairs), np.int64)])),
        ],
        COUNTED,
    )


def _added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    summed = pa.Table.from_batches(held).group_by(COUNTED[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns(COUNTED).to_batches(max_chunksize=GIVEN_ROWS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of all runs of a task. Rows are held and added up; sums that stay too many are given out, equal keys or not."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, 2, RUN_BYTES):
        held.append(_of_run(batch))
        size += held[-1].num_rows
        if size > HELD_ROWS:
            held = _added(held)
            size = sum(b.num_rows for b in held)
            if size > HELD_ROWS // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from _added(held)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, nulls read as ''.

    Every group has one more row whose term is null, n and docs 0, so that groups without terms are known.
    """
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """The counts of terms in at least ``least_docs`` documents of their language, with lang_n, their occurrences there.

    ``leads`` is true in one row of each (language, term). Rows without a term stay.
    """
    by_term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns({
            "lang_n": F.sum("n").over(by_term),
            "lang_docs": F.sum("docs").over(by_term),
            "leads": (F.min("source").over(by_term) == F.col("source")) & F.col("term").isNotNull(),
        })
        .where((F.col("lang_docs") >= least_docs) | F.col("term").isNull())
        .drop("docs", "lang_docs")
    )


def _share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / size), exact for any counts."""
    return (F.lit(1).cast("long") + F.call_function("div", (n + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), size.cast("decimal(38,0)"))).cast("long")


F_SQL = "((p - q) * (p - q)) div q"


def _sizes(kept: DataFrame) -> DataFrame:
    """One row for each group: its size and its language's (occurrences plus kept terms), the number of kept terms, the zero share."""
    rows = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("leads"))
    in_lang = Window.partitionBy("lang")
    sized = rows.withColumns({"terms": F.sum("leads").over(in_lang), "lang_n": F.sum("n").over(in_lang)})
    size = F.col("n") + F.col("terms")
    return sized.select(
        "lang", "source", "terms", size.alias("size"), (F.col("lang_n") + F.col("terms")).alias("lang_size"),
        F.when(F.col("terms") > 0, _share(F.lit(0), size)).alias("zero"),
    )


def measure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) in 64 bits: shares lie between 1 and SCALE + 1."""
    return (p - q) * (p - q) // q


class Rows:
    """The count matrix of one language inside one block of terms: a row for each source."""

    def __init__(self, zero: np.ndarray, row: np.ndarray, term: np.ndarray, share: np.ndarray):
        """``zero``: the share of a term without occurrences, for each source. Cells: row, term and share."""
        self.zero = zero
        by_row, by_term = np.argsort(row, kind="stable"), np.argsort(term, kind="stable")
        self.row_at = np.searchsorted(row[by_row], np.arange(len(zero) + 1))
        self.term, self.share = term[by_row], share[by_row]
        # term-major index
        self.term_at = np.searchsorted(term[by_term], np.arange(int(term.max(initial=-1)) + 2))
        self.peer, self.peer_share = row[by_term], share[by_term]

    def cells(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.row_at[i], self.row_at[i + 1])
        return self.term[span], self.share[span]

    def scattered(self, i: int) -> np.ndarray:
        """For every peer, over the terms that row and peer share: the measure less both baselines plus their common part."""
        out = np.zeros(len(self.zero), np.int64)
        terms, shares = self.cells(i)
        lengths = self.term_at[terms + 1] - self.term_at[terms]
        ends = np.cumsum(lengths)
        own = self.zero[i]
        start = 0
        while start < len(terms):
            before = ends[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + SCATTERED, side="right")))
            many = lengths[start:stop]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(self.term_at[terms[start:stop]], many) + within
            p, peer, q = np.repeat(shares[start:stop], many), self.peer[at], self.peer_share[at]
            zero = self.zero[peer]
            np.add.at(out, peer, measure(p, q) - measure(p, zero) - measure(own, q) + measure(own, zero))
            start = stop
        return out

    def baselines(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """For every peer, over the terms of row i: what its shares add where the peer has none, as p (row i, peer) and as q (peer, row i)."""
        as_p, as_q = np.zeros(len(self.zero), np.int64), np.zeros(len(self.zero), np.int64)
        _, shares = self.cells(i)
        shares, times = np.unique(shares, return_counts=True)
        own = self.zero[i]
        step = max(1, SCATTERED // max(1, len(self.zero)))
        for at in range(0, len(shares), step):
            p, n = shares[at : at + step, None], times[at : at + step, None]
            as_p += (n * (measure(p, self.zero) - measure(own, self.zero))).sum(axis=0)
            as_q += (n * (measure(self.zero, p) - measure(self.zero, own))).sum(axis=0)
        return as_p, as_q


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of terms, all languages: (lang, source, item, value) partial sums of every pair that the block touches."""
    table = pa.Table.from_batches(batches)
    langs = table.column("lang").combine_chunks().dictionary_encode()
    # sources, terms and shares of one language at a time
    for k, lang in enumerate(langs.dictionary):
        part = table.filter(pc.equal(langs.indices, k)).combine_chunks()
        groups = part.filter(pc.is_null(part.column("term")))
        sources = groups.column("source").combine_chunks()
        zero = groups.column("share").combine_chunks().fill_null(1).to_numpy()
        # every kept term is counted once: by the first block
        first, terms = groups.column("first")[0].as_py(), groups.column("terms")[0].as_py()
        cells = part.filter(pc.is_valid(part.column("term")))
        row = pc.index_in(cells.column("source"), sources).combine_chunks().to_numpy().astype(np.int64)
        term = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        rows = Rows(zero, row, term, cells.column("share").combine_chunks().to_numpy())
        for i in range(len(zero)):
            as_p, as_q = rows.baselines(i)
            as_p += rows.scattered(i)
            if first:
                as_p += terms * measure(zero[i], zero)
            for value, peer_is_row in ((as_p, False), (as_q, True)):
                peers = np.arange(len(zero)) if first else np.flatnonzero(value)
                peers = peers[peers != i]
                own = sources.take(pa.array(np.full(len(peers), i)))
                others = sources.take(pa.array(peers))
                names = [others, own] if peer_is_row else [own, others]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(peers)), *names, pa.array(value[peers])], ["lang", "source", "item", "value"]
                )


def _pairs(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    n = kept.where(F.col("term").isNotNull()).count()
    blocks = max(1, -(-n // BLOCK_CELLS))
    cells = kept.where(F.col("term").isNotNull()).join(sizes, ["lang", "source"]).select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).alias("block"), "lang", "source", "term",
        _share(F.col("n"), F.col("size")).alias("share"), "terms", F.lit(None).cast("boolean").alias("first"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    rows = sizes.select(every, "lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("share"), "terms")
    rows = rows.withColumn("first", F.col("block") == 0)
    summed = cells.unionByName(rows).groupBy("block").applyInArrow(_block_sums, "lang string, source string, item string, value bigint")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every kept term that a source uses more than its language does."""
    shares = kept.where(F.col("term").isNotNull() & (F.col("n") > 0)).join(sizes, ["lang", "source"])
    shares = shares.withColumns({"p": _share(F.col("n"), F.col("size")), "q": _share(F.col("lang_n"), F.col("lang_size"))})
    return shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(F_SQL).alias("value"))


def audit(docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its peers, and by which terms.

    Part ``pair``: every other source of the language; value is the sum over all kept terms of floor((p - q)^2 / q), p the share of
    the term in the source and q in the peer, all ranks. Part ``term``: kept terms with a greater share in the source than in
    the language, the same measure, the first ``top_terms``. Shares are 1 + floor(10^9 (n + 1) / (N + V)) for n of N occurrences and
    V kept terms. Ranks go by value, then by the UTF-8 bytes of the item.

    Null text, language and source are read as ''. Each row of ``docs`` is a document, repeated or not. A group without terms
    takes part with the shares of no occurrences; in a language without kept terms all pairs have value 0. The only source of a
    language has no pairs, an empty table gives no rows. Other columns are not read. Sums stay below 2^63 up to 2 billion kept terms of
    a language.
    """
    kept = stored(kept_terms(term_counts(docs, lang, source, text), settings.least_docs), "kept-terms")
    sizes = stored(_sizes(kept), "group-sizes")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ordered)
    pairs = _pairs(kept, sizes).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = _terms(kept, sizes).withColumn("rank", rank).where(F.col("rank") <= settings.top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
