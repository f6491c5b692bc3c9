"""SimHash near-duplicates found by the generalised pigeonhole principle.

The bits of a fingerprint are dealt into partitions, correlated bits together. If the thresholds of
the partitions add up to the maximum distance less the number of partitions plus one, any two fingerprints
within that distance agree within the threshold of at least one partition; a threshold of -1 leaves a partition out.
Each fingerprint gets thresholds of its own, by dynamic programming on the number of candidates that the bit
statistics of the whole table predict, and probes all variants of its partition values within them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.components import components
from stayline.llm.storage import stored

BITS = 64
SEED = 42
#: Bits counted together for the statistics; a table of two to this power for each block.
BLOCK_BITS = 8
#: A key with more fingerprints than this is compared in blocks, below it by a plain join.
PLAIN_KEY = 64
#: Fingerprints on either side of one block comparison.
BLOCK_ROWS = 1024
#: Keys up to this number are sent to every task (16 bytes each); beyond it they are joined.
SENT_KEYS = 100_000
#: Bytes of a text that are held as words at a time.
TEXT_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, min(start + TEXT_BLOCK, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end].lower().split()
        start = end


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if set in over half the hashes of its word shingles.

    A-Z count as a-z. Fewer words than ``shingle`` form one shingle; no word gives 0.
    """
    ones, n, carried = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _word_blocks(data):
        words = carried + words
        carried = words[max(0, len(words) - shingle + 1):] if shingle > 1 else []
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        found = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
        hashes = np.array(found, np.uint64)
        for at in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    if not n and carried:
        return digest(b" ".join(carried), SEED)
    value = int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little") if n else 0
    return value


def fingerprint_column(text: str | Column = "text", shingle: int = 3) -> Column:
    """Fingerprint of a text column as a long with the same bits; null counts as empty."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        values = [fingerprint(t, shingle) if t else 0 for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return fingerprints(F.col(text) if isinstance(text, str) else text)


def hex_digits(value: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy().view(np.uint64)


def _packed(bits: np.ndarray, columns: list[int]) -> np.ndarray:
    """The value that the bits at ``columns`` form, first column lowest."""
    out = np.zeros(len(bits), np.int64)
    for place, column in enumerate(columns):
        out |= bits[:, column].astype(np.int64) << place
    return out


def _sums(uniq: DataFrame, length: int, add) -> np.ndarray:
    """Sum over all fingerprints of the vectors that ``add(bits)`` gives; ``length`` numbers reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += add(_bits(_values(batch)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(length, np.int64)
    for row in uniq.select("fp").mapInArrow(partial, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


def bit_correlations(uniq: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits over all distinct fingerprints."""
    both = _sums(uniq, BITS * BITS, lambda bits: (bits.T.astype(np.float64) @ bits.astype(np.float64)).astype(np.int64).ravel())
    both = both.reshape(BITS, BITS).astype(float)
    n = max(1, int(uniq.count()))
    mean = both.diagonal() / n
    spread = np.sqrt(mean * (1 - mean))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    return np.nan_to_num(out)


def grouped_bits(correlations: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits dealt into partitions of nearly equal size; each starts with the bit that is most correlated
    with the rest and takes the bits that are most correlated with it, lower bits first on ties."""
    left, out = list(range(BITS)), []
    for k in range(partitions):
        size = -(-len(left) // (partitions - k))
        group = [max(left, key=lambda b: (correlations[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (correlations[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(group)
    return out


def _blocks(group: list[int]) -> list[list[int]]:
    return [group[at:at + BLOCK_BITS] for at in range(0, len(group), BLOCK_BITS)]


def _near_shares(histogram: np.ndarray, most: int) -> np.ndarray:
    """For each value of a block and each distance up to ``most`` the share of rows at that distance."""
    values = np.arange(len(histogram), dtype=np.uint64)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    share = histogram / max(1, histogram.sum())
    return np.stack([(apart == d) @ share for d in range(most + 1)], axis=1)


def _convolved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distance shares of two blocks together, distances beyond the last column left out."""
    out = np.zeros_like(left)
    for d in range(left.shape[1]):
        for e in range(left.shape[1] - d):
            out[:, d + e] += left[:, d] * right[:, e]
    return out


class Plan:
    """Partitions of the bits and what is known of each block's values."""

    def __init__(self, groups: list[list[int]], histograms: list[list[np.ndarray]], n: int, distance: int):
        self.groups, self.n, self.distance = groups, n, distance
        self.shares = [[_near_shares(h, distance) for h in blocks] for blocks in histograms]
        self.blocks = [_blocks(g) for g in groups]
        # probes of a partition at each threshold from -1
        self.probes = [[0] + [sum(comb(len(g), r) for r in range(t + 1)) for t in range(distance + 1)] for g in groups]

    def candidates(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each partition, rows expected within each threshold from 0 of every fingerprint."""
        out = []
        for blocks, shares in zip(self.blocks, self.shares):
            near = None
            for block, share in zip(blocks, shares):
                own = share[_packed(bits, block)]
                near = own if near is None else _convolved(near, own)
            out.append(self.n * np.cumsum(near, axis=1))
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (row, partition) of least predicted cost, a probe or a candidate being one, and that cost."""
        budget, rows = self.distance + 1, len(bits)
        best = np.full((rows, budget + 1), np.inf)
        best[:, 0] = 0
        choices = []
        for found, probes in zip(self.candidates(bits), self.probes):
            cost = np.concatenate([np.zeros((rows, 1)), found + np.array(probes[1:])], axis=1)
            new, choice = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for spent in range(budget + 1):
                for own in range(spent + 1):
                    total = best[:, spent - own] + cost[:, own]
                    less = total < new[:, spent]
                    new[less, spent], choice[less, spent] = total[less], own
            best = new
            choices.append(choice)
        out, spent = np.zeros((rows, len(self.groups)), np.int64), np.full(rows, budget)
        for k in reversed(range(len(self.groups))):
            own = choices[k][np.arange(rows), spent]
            out[:, k], spent = own - 1, spent - own
        return out, best[:, budget]


def make_plan(uniq: DataFrame, distance: int) -> Plan:
    """The plan of least mean cost among those of two to ``distance`` + 2 partitions.

    What reaches the driver is bounded whatever the input: 64 x 64 sums and, for each number of
    partitions, one histogram of 256 values for each block of 8 bits, all over every distinct fingerprint.
    """
    correlations = bit_correlations(uniq)
    options = [grouped_bits(correlations, m) for m in range(min(2, distance + 1), distance + 3)]
    blocks = [block for groups in options for group in groups for block in _blocks(group)]
    width = 1 << BLOCK_BITS

    def counts(bits: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_packed(bits, block), minlength=width) for block in blocks])

    table = iter(_sums(uniq, width * len(blocks), counts).reshape(-1, width))
    n = int(uniq.count())
    plans = []
    for groups in options:
        histograms = [[next(table)[: 1 << len(block)] for block in _blocks(group)] for group in groups]
        plans.append(Plan(groups, histograms, n, distance))

    def cost(bits: np.ndarray) -> np.ndarray:
        return np.array([np.minimum(plan.thresholds(bits)[1], 1e12).sum() for plan in plans]).astype(np.int64)

    costs = _sums(uniq, len(plans), cost)
    return plans[int(np.argmin(costs))]


def _keys(plan: Plan, bits: np.ndarray) -> list[np.ndarray]:
    """For each partition the key of each row: partition number above the value (58 bits at most)."""
    return [_packed(bits, group) + (k << 58) if len(group) < 58 else _packed(bits, group) for k, group in enumerate(plan.groups)]


def _entry_rows(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for key in _keys(plan, _bits(fp.view(np.uint64))):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _probe_rows(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            fp = batch.column("fp").to_numpy()
            bits = _bits(fp.view(np.uint64))
            thresholds, _ = plan.thresholds(bits)
            for k, key in enumerate(_keys(plan, bits)):
                for radius in range(int(thresholds[:, k].max(initial=-1)) + 1):
                    use = thresholds[:, k] >= radius
                    for flips in combinations(range(len(plan.groups[k])), radius):
                        flipped = key[use] ^ sum(1 << place for place in flips)
                        yield pa.RecordBatch.from_arrays([pa.array(flipped), pa.array(fp[use])], ["key", "fp"])


def _block_links(distance: int, table: pa.Table) -> pa.Table:
    """Links of one block of probes with one block of entries, as a star for each group that hangs together."""
    fp, probe = table.column("fp").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
    nodes = np.unique(fp)
    q, d = np.unique(fp[probe]), np.unique(fp[~probe])
    linked = np.bitwise_count(q.view(np.uint64)[:, None] ^ d.view(np.uint64)[None, :]) <= distance
    at_q, at_d = np.searchsorted(nodes, q), np.searchsorted(nodes, d)
    label = np.arange(len(nodes))
    while len(q) and len(d):
        before = label.copy()
        np.minimum.at(label, at_q, np.where(linked, label[at_d][None, :], len(nodes)).min(1))
        np.minimum.at(label, at_d, np.where(linked, label[at_q][:, None], len(nodes)).min(0))
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return pa.table({"a": pa.array(nodes[own]), "b": pa.array(nodes[label[own]])})


def _hot_links(entries: DataFrame, probes: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Links through the keys of ``hot`` (key, entry_blocks, probe_blocks), each dealt into pairs of blocks."""
    at = lambda blocks: F.pmod(F.xxhash64("fp"), F.col(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = entries.join(hot, "key").select("key", "fp", F.lit(False).alias("probe"), at("entry_blocks").alias("e"), all_of("probe_blocks").alias("p"))
    right = probes.join(hot, "key").select("key", "fp", F.lit(True).alias("probe"), at("probe_blocks").alias("p"), all_of("entry_blocks").alias("e"))
    return left.unionByName(right).groupBy("key", "e", "p").applyInArrow(lambda t: _block_links(distance, t), "a long, b long")


def links(uniq: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in ``uniq`` (column fp) that connect all within ``distance`` bits.

    Keys with few entries are joined and every pair within the distance is given. A key with more is
    compared in blocks of bounded size, and each block gives a star for what hangs together, so no group gives all its
    pairs. Pairs may repeat.
    """
    if distance < 1:
        return uniq.sparkSession.createDataFrame([], "a long, b long")
    plan = make_plan(uniq, distance)
    entries = stored(uniq.select("fp").mapInArrow(lambda b: _entry_rows(plan, b), "key long, fp long"), "entries")
    probes = stored(uniq.select("fp").mapInArrow(lambda b: _probe_rows(plan, b), "key long, fp long"), "probes")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PLAIN_KEY)
    asked = probes.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    hot = stored(many.join(asked, "key").select("key", blocks(F.col("n")).alias("entry_blocks"), blocks(F.col("m")).alias("probe_blocks")), "hot")
    n_hot = hot.count()
    sent = F.broadcast(hot) if n_hot <= SENT_KEYS else hot
    cold_entries = entries.join(sent, "key", "left_anti") if n_hot else entries
    e, p = cold_entries.alias("e"), probes.alias("p")
    near = (F.col("p.fp") > F.col("e.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("e.fp"))) <= distance)
    plain = p.join(e, (F.col("p.key") == F.col("e.key")) & near).select(F.col("p.fp").alias("a"), F.col("e.fp").alias("b"))
    return plain.unionAll(_hot_links(entries, probes, sent, distance)) if n_hot else plain


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (long), component_id, row_key (two hashes of id and text).

    Two rows are linked if their fingerprints differ in ``distance`` bits or fewer; component_id is the smallest
    doc_id that can be reached. Rows without an id are linked like others but name no component: one made of
    such rows only has a null component_id, and fp_root still tells it apart. Rows without a word have
    fingerprint 0. Rows that share a doc_id stay separate rows. Other columns of ``docs`` are not read.
    """
    rows = stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp"),
            F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("k1"),
            F.xxhash64(f"`{text}`", f"`{doc_id}`").alias("k2"),
        ),
        "fingerprints",
    )
    uniq = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = stored(components(links(uniq, distance)), "components")
    rooted = uniq.join(found, uniq["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("fp_root"))
    least = rooted.groupBy("fp_root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "fp_root").join(least, "fp_root")
    return rows.join(classes, "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last, then by a hash of
    id and text. Of rows that repeat both, one stays."""
    found = stored(near_duplicates(docs, text, doc_id, shingle, distance), "near_duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "k1", "k2")
    first = found.groupBy("fp_root").agg(F.min(order).alias("first")).select("first.k1", "first.k2")
    copies = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    stay = stored(first.join(copies, ["k1", "k2"]), "stay")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(
        F.struct(*own).alias("doc"),
        F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("k1"),
        F.xxhash64(f"`{text}`", f"`{doc_id}`").alias("k2"),
    )
    single = keyed.join(stay.where("n = 1"), ["k1", "k2"], "left_semi").select("doc.*")
    repeated = keyed.join(stay.where("n > 1"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc.*")
    return single.unionAll(repeated)
