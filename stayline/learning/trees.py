"""Tree ensembles grown level by level, all trees of a level together.

Each level is one Spark job for forests and two for extremely randomised trees: tasks find the node of each of their rows in each tree
and add up what its division needs, packed as one row for each tree; these rows meet by tree, are added, and the best division
of every open node goes to the driver, which holds the ensemble. What is added are whole numbers, and every random choice is a
hash of seed, tree, node and feature or row, so an ensemble depends neither on partitions nor on cores. A task keeps nothing
between jobs: a lost executor costs its tasks of one level.

A node divides by ``feature <= cut``. Nodes are numbered as in a heap: node i has children 2i + 1 and 2i + 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rows that a task codes at a time, as their codes fit two bytes; coded rows that it holds, and works on, at a time
CHUNK_ROWS, HELD_ROWS, PART_ROWS = (1 << 16) - 1, 1 << 19, 1 << 14
# rows whose quantiles make the bins of a forest
BIN_ROWS = 10_000
# rows for each task when there are cores for all of them, and at most
LEAST_TASK_ROWS, MOST_TASK_ROWS = 1 << 10, 1 << 19
# bytes of what is sent to tasks and comes back of one level; with more, the trees are taken in several jobs
LEVEL_BYTES = 256 << 20
# features looked at for each one that may be tried: constant ones are passed over
POOL = 2


@dataclass(frozen=True)
class Growth:
    """How an ensemble is grown.

    ``random_cuts``: one cut for each tried feature, at random between the node's least and greatest value; otherwise the best of ``bins``.
    ``bootstrap``: every tree draws its rows with replacement (Poisson counts), and classes are balanced by each tree's own draws.
    """

    trees: int
    random_cuts: bool
    bootstrap: bool
    max_depth: int = 10
    min_leaf: int = 3
    seed: int = 42
    bins: int = 32


def extra_trees(trees: int, **other: int) -> Growth:
    return Growth(trees, random_cuts=True, bootstrap=False, **other)


def forest(trees: int, **other: int) -> Growth:
    return Growth(trees, random_cuts=False, bootstrap=True, **other)


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers, element by element."""
    x = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            x = (x ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """A number from 0 to below 1 for each hash."""
    return (mixed(*parts) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


DRAW, ORDER, CUT = range(3)
# probabilities of at most 0, 1, 2, ... draws with mean one
_DRAWN = np.cumsum([1 / np.e / float(np.prod(np.arange(1.0, k + 1))) for k in range(19)])


# draws by the first 12 bits of a hash; -1: the other bits decide
_LEADING = np.arange(1 << 12)
_DRAWN_BY = np.searchsorted(_DRAWN, _LEADING / (1 << 12), side="right")
_DRAWN_BY = np.where(_DRAWN_BY == np.searchsorted(_DRAWN, (_LEADING + 1) / (1 << 12), side="right"), _DRAWN_BY, -1)


def draws(seed: int, tree: int, row_hash: np.ndarray) -> np.ndarray:
    """How often a tree draws each row."""
    hashes = mixed(DRAW, seed, tree, row_hash)
    times = _DRAWN_BY[(hashes >> np.uint64(52)).astype(np.int64)]
    open_ = np.flatnonzero(times < 0)
    times[open_] = np.searchsorted(_DRAWN, (hashes[open_] >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")
    return times


def pool(seed: int, tree: int, nodes: np.ndarray, features: int, tried: int) -> np.ndarray:
    """For each node the features in the order in which they may be tried, as far as they are looked at."""
    hashes = mixed(ORDER, seed, tree, nodes[:, None], np.arange(features)[None, :])
    n = min(features, POOL * tried)
    few = np.argpartition(hashes, n - 1, axis=1)[:, :n]
    order = np.argsort(np.take_along_axis(hashes, few, axis=1), axis=1)
    return np.take_along_axis(few, order, axis=1).astype(np.int32)


@dataclass(frozen=True)
class Ensemble:
    """Grown trees: for each tree and node the feature (-1: none), the cut, the share of class 1 by weight; importances by feature."""

    feature: np.ndarray
    cut: np.ndarray
    probability: np.ndarray
    importance: np.ndarray

    def predict(self, cells: np.ndarray) -> np.ndarray:
        """The mean share of class 1 over all trees."""
        depth = (self.feature.shape[1] + 1).bit_length() - 2
        total, columns, row = np.zeros(len(cells)), np.ascontiguousarray(cells.T), np.arange(len(cells))
        for tree in range(len(self.feature)):
            total += self.probability[tree][_descend(self.feature[tree], self.cut[tree], columns, row, depth)]
        return total / len(self.feature)


def _descend(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray, row: np.ndarray, levels: int) -> np.ndarray:
    """The node that each of the rows has reached after so many levels; ``columns`` has a line for each feature, and cuts are in its units."""
    n, flat, numbers = columns.shape[1], columns.ravel(), np.arange(len(feature))
    # a node without a division keeps its rows
    leaf = feature < 0
    start = np.where(leaf, 0, feature).astype(np.int64) * n
    # codes are not below 0, but a cut may be
    cut = np.where(leaf, np.inf, cut) if columns.dtype.kind == "f" else np.where(leaf, 1 << 30, cut).astype(np.int32)
    left = np.where(leaf, numbers, 2 * numbers + 1)
    node = np.zeros(len(row), np.int64)
    for level in range(levels):
        if level:
            node = left.take(node) + (flat.take(start.take(node) + row) > cut.take(node))
        else:
            node = left[0] + (flat.take(start[0] + row) > cut[0])
    return node


@dataclass
class _Level:
    """What tasks need to know of one level: the trees so far, open nodes, and what is tried there."""

    growth: Growth
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    open: dict[int, np.ndarray]
    features: int
    tried: int
    edges: list[np.ndarray] = field(default_factory=list)
    # of random cuts: for each tree the tried features and their cuts, a row for each open node
    chosen: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    class_weight: dict[int, np.ndarray] = field(default_factory=dict)

    def tried_features(self, tree: int) -> np.ndarray:
        if tree in self.chosen:
            return self.chosen[tree][0]
        return pool(self.growth.seed, tree, self.open[tree], self.features, self.tried)

    def bins_of(self, features: np.ndarray) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])[features]


def _chunks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row hashes, labels and cells of at most ``CHUNK_ROWS`` rows at a time."""

    def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, labels = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
        cells = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, features) for b in held])
        return hashes.view(np.uint64), labels, cells

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            if held and n + part.num_rows > CHUNK_ROWS:
                yield joined(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield joined(held)


@dataclass
class _Coded:
    """Rows whose cells are codes that keep the order of each feature: bins of a forest, else places among the chunk's distinct values."""

    hashes: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    # codes of the divisions so far
    cuts: np.ndarray
    # of random cuts: the distinct values, feature after feature, where each feature's begin, and for each tree the lowest codes above the tried cuts
    values: np.ndarray | None = None
    begins: np.ndarray | None = None
    above: dict[int, np.ndarray] = field(default_factory=dict)


def _below(values: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, side: str) -> np.ndarray:
    """The code of each cut: ``x <= cut`` for a value just where its code is at most this one. No feature: 0."""
    out, less = np.zeros(feature.shape, np.int64), int(side == "right")
    order = np.argsort(feature, axis=None, kind="stable")
    ends = np.searchsorted(feature.ravel()[order], np.arange(len(values) + 1))
    for f, known in enumerate(values):
        at = order[ends[f] : ends[f + 1]]
        out.reshape(-1)[at] = np.searchsorted(known, cut.reshape(-1)[at], side=side) - less
    return out


def _coded(chunk: tuple, level: _Level) -> list[_Coded]:
    """The rows of a chunk in parts that a processor's cache holds."""
    hashes, labels, cells = chunk

    def parts(codes: np.ndarray, *of_chunk) -> list[_Coded]:
        cuts = [slice(a, a + PART_ROWS) for a in range(0, len(hashes), PART_ROWS)]
        return [_Coded(hashes[c], labels[c], np.ascontiguousarray(codes[:, c]), *of_chunk) for c in cuts]

    if not level.growth.random_cuts:
        codes = np.stack([np.searchsorted(e, cells[:, f]) for f, e in enumerate(level.edges)]).astype(np.uint8 if level.growth.bins <= 1 << 8 else np.uint16)
        return parts(codes, _below(level.edges, level.feature, level.cut, "left"))
    codes, values = np.empty(cells.shape[::-1], np.uint16), []
    for f in range(level.features):
        known, codes[f] = np.unique(cells[:, f], return_inverse=True)
        values.append(known)
    begins = np.cumsum([0, *map(len, values)])[:-1]
    # a cut below all values of a chunk has code -1
    cuts = _below(values, level.feature, level.cut, "right")
    above = {}
    if level.chosen:
        # all trees at once
        codes_of = _below(values, *(np.concatenate([c[i] for c in level.chosen.values()]) for i in (0, 1)), "right")
        ends = np.cumsum([len(f) for f, _ in level.chosen.values()])
        above = dict(zip(level.chosen, np.split((codes_of + 1).astype(np.uint16), ends[:-1])))
    return parts(codes, cuts, np.concatenate(values), begins, above)


def _blocks(batches: Iterator[pa.RecordBatch], level: _Level) -> Iterator[list[_Coded]]:
    """Coded parts of at most ``HELD_ROWS`` rows, or one chunk."""
    held, n = [], 0
    for chunk in _chunks(batches, level.features):
        if held and n + len(chunk[0]) > HELD_ROWS:
            yield held
            held, n = [], 0
        held.extend(_coded(chunk, level))
        n += len(chunk[0])
    if held:
        yield held


def _rows_of(level: _Level, tree: int, chunk: _Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a chunk that are at open nodes of a tree: slots, row numbers, times drawn. Slots ascend."""
    if level.growth.bootstrap:
        times = draws(level.growth.seed, tree, chunk.hashes)
        row = np.flatnonzero(times)
        times = times[row]
    else:
        row = np.arange(len(chunk.hashes))
        times = np.ones(len(row), np.int64)
    place = np.full(level.feature.shape[1] + (1 << level.depth), -1, np.int16 if level.depth < 15 else np.int64)
    place[level.open[tree]] = np.arange(len(level.open[tree]))
    slot = place.take(_descend(level.feature[tree], chunk.cuts[tree], chunk.codes, row, level.depth))
    if len(level.open[tree]) < 1 << level.depth:
        here = np.flatnonzero(slot >= 0)
        slot, row, times = slot[here], row[here], times[here]
    if len(level.open[tree]) > 1:
        order = np.argsort(slot, kind="stable")
        slot, row, times = slot[order], row[order], times[order]
    return slot, row, times


def _starts(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending slots, those that occur, where each begins and how long it is."""
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    return slot[first].astype(np.int64), first, np.diff(first, append=len(slot))


def _emit(tree: int, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), *[pa.array([part.tobytes()], pa.binary()) for part in parts.values()]], ["tree", *parts]
    )


def _ranges(batches: Iterator[pa.RecordBatch], level: _Level) -> Iterator[pa.RecordBatch]:
    """Least and greatest values of the pool's features at each open node."""
    for block in _blocks(batches, level):
        for t in sorted(level.open):
            tried = level.tried_features(t)
            low, high = np.full(tried.shape, np.inf), np.full(tried.shape, -np.inf)
            for chunk in block:
                slot, row, _ = _rows_of(level, t, chunk)
                if not len(row):
                    continue
                at, first, length = _starts(slot)
                flat, begin = chunk.codes.ravel(), tried[at].astype(np.int64) * len(chunk.hashes)
                for k in range(tried.shape[1]):
                    if k >= level.tried:
                        # a feature that varies in some rows varies in all of them: what lies behind enough of these is not tried
                        enough = (low[at, :k] < high[at, :k]).sum(axis=1) >= level.tried
                        if enough.all():
                            break
                        row, at, begin, length = row[np.repeat(~enough, length)], at[~enough], begin[~enough], length[~enough]
                        first = np.cumsum(length) - length
                    codes = flat.take(np.repeat(begin[:, k], length) + row)
                    offset = chunk.begins[tried[at, k]]
                    low[at, k] = np.minimum(low[at, k], chunk.values[offset + np.minimum.reduceat(codes, first)])
                    high[at, k] = np.maximum(high[at, k], chunk.values[offset + np.maximum.reduceat(codes, first)])
            if np.isfinite(low).any():
                yield _emit(t, {"low": low, "high": high})


# of some parts, rows and draws of both classes are added in one number: the bits of rows, and of draws
_ROW_BITS, _DRAW_BITS = 17, 18


def _unpacked(sums: np.ndarray) -> np.ndarray:
    """Rows and draws of either class, from numbers that hold the three."""
    sums = sums.astype(np.int64)
    mask = (1 << _DRAW_BITS) - 1
    return np.stack([sums & (1 << _ROW_BITS) - 1, sums >> _ROW_BITS & mask, sums >> _ROW_BITS + _DRAW_BITS], axis=-1)


def _runs_of_draws(times: np.ndarray) -> list[slice]:
    """Rows in runs whose draws fit their bits; nearly always one."""
    if times.sum() < 1 << _DRAW_BITS:
        return [slice(0, len(times))]
    run = ((1 << _DRAW_BITS) - 1) // max(1, int(times.max()))
    return [slice(a, a + run) for a in range(0, len(times), run)]


def _sums(batches: Iterator[pa.RecordBatch], level: _Level) -> Iterator[pa.RecordBatch]:
    """Rows, and draws of either class: by node, tried feature and bin, or of random cuts by node, and by node and tried feature above the cut."""
    for block in _blocks(batches, level):
        for t in sorted(level.open):
            tried = level.tried_features(t)
            add = _above_cuts if level.growth.random_cuts else _by_bin
            total, packed, room = 0, None, (0, 0)
            for chunk in block:
                slot, row, times = _rows_of(level, t, chunk)
                weight = 1.0 + times * np.array([1 << _ROW_BITS, 1 << _ROW_BITS + _DRAW_BITS]).take(chunk.labels[row])
                for run in _runs_of_draws(times) if len(row) else []:
                    found, need = add(level, t, tried, chunk, slot[run], row[run], weight[run]), (len(row[run]), int(times[run].sum()))
                    if packed is not None and min(r - n for r, n in zip(room, need)) >= 0:
                        packed += found
                    else:
                        if packed is not None:
                            total = total + _unpacked(packed)
                        packed, room = found, ((1 << _ROW_BITS) - 1, (1 << _DRAW_BITS) - 1)
                    room = tuple(r - n for r, n in zip(room, need))
            if packed is not None:
                total = total + _unpacked(packed)
                kind = next(k for k in (np.uint16, np.uint32, np.int64) if total.max() <= np.iinfo(k).max)
                yield _emit(t, {"value": total.astype(kind)})


def _above_cuts(level: _Level, tree: int, tried: np.ndarray, chunk: _Coded, slot: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(tried), 1 + tried.shape[1]))
    at, first, length = _starts(slot)
    out[at, 0] = np.add.reduceat(weight, first)
    flat, begin, lowest = chunk.codes.ravel(), tried[at].astype(np.int64) * len(chunk.hashes), chunk.above[tree][at]
    for k in range(tried.shape[1]):
        above = flat.take(np.repeat(begin[:, k], length) + row) >= np.repeat(lowest[:, k], length)
        out[at, 1 + k] = np.add.reduceat(weight * above, first)
    return out


def _by_bin(level: _Level, tree: int, tried: np.ndarray, chunk: _Coded, slot: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """In the order of tried features, then nodes, then bins; of each feature as many as it has."""
    out = []
    at, _, length = _starts(slot)
    flat, begin = chunk.codes.ravel(), tried[at].astype(np.int64) * len(chunk.hashes)
    bins = level.bins_of(tried)
    for k in range(tried.shape[1]):
        ends = np.cumsum(bins[:, k])
        cell = np.repeat((ends - bins[:, k])[at], length) + flat.take(np.repeat(begin[:, k], length) + row)
        out.append(np.bincount(cell, weight, ends[-1]))
    return np.concatenate(out)


def _whole_sums(level: _Level, tried: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(node, tried feature, side or bin, rows and draws) from what ``_sums`` adds up."""
    if level.growth.random_cuts:
        values = values.reshape(len(tried), 1 + tried.shape[1], 3)
        return np.stack([values[:, :1] - values[:, 1:], values[:, 1:]], axis=2)
    out = np.zeros((tried.shape[1], len(tried), level.growth.bins, 3), np.int64)
    out[np.arange(level.growth.bins) < level.bins_of(tried.T)[..., None]] = values
    return out.transpose(1, 0, 2, 3)


def _by_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Rows of sorted batches, one at a time, with the tree they belong to."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column(0)[at].as_py(), batch.slice(at, 1)


def _array(batch: pa.RecordBatch, column: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[0].as_buffer(), kind)


def _choose_cuts(batches: Iterator[pa.RecordBatch], level: _Level) -> Iterator[pa.RecordBatch]:
    """The features that are tried at each open node, the first that are not constant there, and a random cut of each."""

    def out(tree: int, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        feature, tried = pool(level.growth.seed, tree, level.open[tree], level.features, level.tried), level.tried
        constant = ~(low < high)
        first = np.argsort(constant, axis=1, kind="stable")[:, :tried]
        low, high, feature, constant = (np.take_along_axis(x, first, axis=1) for x in (low, high, feature, constant))
        share = uniform(CUT, level.growth.seed, tree, level.open[tree][:, None], feature)
        with np.errstate(invalid="ignore"):
            cut = np.where(constant, np.inf, np.minimum(low + share * (high - low), np.nextafter(high, -np.inf)))
        return pa.RecordBatch.from_arrays(
            [pa.array([tree], pa.int32()), pa.array([feature.astype(np.int32).tobytes()]), pa.array([cut.tobytes()])], ["tree", "feature", "cut"]
        )

    now, low, high = None, None, None
    for tree, batch in _by_tree(batches):
        ends = [_array(batch, i, np.float64).reshape(len(level.open[tree]), -1) for i in (1, 2)]
        if tree != now:
            if now is not None:
                yield out(now, low, high)
            now, (low, high) = tree, ends
        else:
            low, high = np.minimum(low, ends[0]), np.maximum(high, ends[1])
    if now is not None:
        yield out(now, low, high)


def _impurity_left(weighted: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity, from the weights of both classes in the last axis."""
    total = weighted.sum(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, total - (weighted**2).sum(axis=-1) / total, 0.0)


def best_divisions(level: _Level, tree: int, sums: np.ndarray) -> dict[str, np.ndarray]:
    """The best division of each open node from its sums (node, tried feature, side or bin, and rows with draws of both classes).

    Candidates must leave ``min_leaf`` rows on either side; the first of equally good ones wins. Feature -1: no candidate.
    """
    total = sums[:, 0].sum(axis=1)
    weight = level.class_weight.get(tree)
    if weight is None:
        weight = balanced(total[0, 1:])
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left
    fits = (left[..., 0] >= level.growth.min_leaf) & (right[..., 0] >= level.growth.min_leaf)
    # one class alone is not divided
    fits &= ((total[:, 1] > 0) & (total[:, 2] > 0))[:, None, None]
    if not level.growth.random_cuts:
        # of the pool, the first that are not constant in the node
        varies = (sums[..., 0] > 0).sum(axis=2) > 1
        fits &= (varies & (np.cumsum(varies, axis=1) <= level.tried))[:, :, None]
    rest = _impurity_left(left[..., 1:] * weight) + _impurity_left(right[..., 1:] * weight)
    rest = np.where(fits, rest, np.inf).reshape(len(sums), -1)
    best = np.argmin(rest, axis=1)
    node = np.arange(len(sums))
    k, side = np.divmod(best, left.shape[2])
    possible = np.isfinite(rest[node, best])
    feature = np.where(possible, level.tried_features(tree)[node, k], -1)
    if level.growth.random_cuts:
        cut = level.chosen[tree][1][node, k]
    else:
        cut = np.array([level.edges[f][s] if f >= 0 and s < len(level.edges[f]) else 0.0 for f, s in zip(feature, side)])
    gain = np.where(possible, _impurity_left(total[:, 1:] * weight) - rest[node, best], 0.0)
    return {"feature": feature.astype(np.int32), "cut": np.where(possible, cut, 0.0), "total": total, "left": left[node, k, side], "gain": gain}


def balanced(drawn: np.ndarray) -> np.ndarray:
    """Class weights n / (2 n_class) of the rows a tree has drawn; their sum is the number of draws."""
    n = drawn.sum()
    with np.errstate(divide="ignore"):
        return np.where(drawn > 0, n / (np.count_nonzero(drawn) * np.maximum(drawn, 1)), 0.0)


def _divide(batches: Iterator[pa.RecordBatch], level: _Level) -> Iterator[pa.RecordBatch]:
    """Add up the sums of each tree and divide its open nodes."""

    def out(tree: int, sums: np.ndarray) -> pa.RecordBatch:
        found = best_divisions(level, tree, sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([tree], pa.int32()), *[pa.array([found[c].astype(kind).tobytes()]) for c, kind in _DIVISION.items()]], ["tree", *_DIVISION]
        )

    now, sums, tried = None, None, None
    for tree, batch in _by_tree(batches):
        if tree != now:
            if now is not None:
                yield out(now, _whole_sums(level, tried, sums))
            now, tried = tree, level.tried_features(tree)
            cells = len(tried) * (1 + tried.shape[1]) if level.growth.random_cuts else int(level.bins_of(tried).sum())
            sums = np.zeros((cells, 3), np.int64)
        packed = batch.column(1)[0].as_buffer()
        sums += np.frombuffer(packed, {2: np.uint16, 4: np.uint32, 8: np.int64}[packed.size // sums.size]).reshape(-1, 3)
    if now is not None:
        yield out(now, _whole_sums(level, tried, sums))


_DIVISION = {"feature": np.int32, "cut": np.float64, "total": np.int64, "left": np.int64, "gain": np.float64}


def _job(rows: DataFrame, level: _Level, add, merge, packed: tuple[str, ...], result: tuple[str, ...]) -> dict[int, list[bytes]]:
    """Sums by task, brought together by tree; one row for each tree comes back, of the size of its open nodes."""
    sent = rows.sparkSession.sparkContext.broadcast(level)
    schema = "tree int, " + ", ".join(f"{name} binary" for name in packed)

    def run(step, batches):
        return step(batches, sent.value)

    partial_sums = rows.mapInArrow(partial(run, add), schema)
    merged = partial_sums.repartition("tree").sortWithinPartitions("tree").mapInArrow(
        partial(run, merge), "tree int, " + ", ".join(f"{name} binary" for name in result)
    )
    found = {r["tree"]: [bytes(r[name]) for name in result] for r in merged.collect()}
    sent.destroy()
    return found


def training_rows(df: DataFrame, n: int, key: Column, label: Column, cells: Column, *others: Column) -> DataFrame:
    """(row_hash, label, cells, others) of ``n`` rows, dealt by hash into as many partitions as rows and cores ask for."""
    rows = df.select(F.xxhash64(key).alias("row_hash"), label.cast("int").alias("label"), cells.alias("cells"), *others)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // MOST_TASK_ROWS), min(cores, -(-n // LEAST_TASK_ROWS)), 1)
    return rows.repartition(parts, "row_hash")


def bin_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """For each feature at most bins - 1 cuts at quantiles of the rows with the lowest hashes, ``BIN_ROWS`` of them or all."""
    n = rows.count()
    few = rows
    if n > BIN_ROWS:
        # rows are drawn by hash, whatever their order; a third more than wanted, of which the lowest stay
        few = rows.where(F.col("row_hash") < F.lit(int(-(2**63) + min(1.0, 4 / 3 * BIN_ROWS / n) * (2**64 - 2048))))
    held = sorted(((r["row_hash"], r["cells"]) for r in few.orderBy("row_hash").limit(2 * BIN_ROWS).collect()), key=lambda r: r[0])[:BIN_ROWS]
    cells = np.array([c for _, c in held], np.float64).reshape(-1, features)
    at = [min(len(cells) - 1, -(-len(cells) * b // bins) - 1) for b in range(1, bins)] if len(cells) else []
    return [np.unique(np.sort(cells[:, f])[at]) if at else np.zeros(0) for f in range(features)]


def grow(rows: DataFrame, features: int, growth: Growth) -> Ensemble:
    """Grow the trees on ``rows`` (row_hash, label 0 or 1, cells: an array of ``features`` finite numbers); store ``rows`` first.

    A node is divided while it is less than ``max_depth`` levels deep, holds both classes and 2 ``min_leaf`` rows, and one of the
    tried features leaves ``min_leaf`` rows on either side. sqrt(features) are tried, constant ones passed over. Rows that
    repeat a key draw alike. Without rows, or with one class, every tree is a single leaf.
    """
    rows = rows.select("row_hash", "label", "cells")
    size = (1 << (growth.max_depth + 1)) - 1
    trees = growth.trees
    feature, cut = np.full((trees, size), -1, np.int32), np.zeros((trees, size))
    probability, importance = np.zeros((trees, size)), np.zeros((trees, features))
    tried = max(1, int(np.sqrt(features)))
    edges = [] if growth.random_cuts else bin_edges(rows, features, growth.bins)
    open_nodes = {t: np.zeros(1, np.int64) for t in range(trees)}
    weight: dict[int, np.ndarray] = {}
    for depth in range(growth.max_depth + 1):
        # the last level has its counts from its parents
        if not open_nodes or depth == growth.max_depth:
            break
        per_node = tried * 12 + 2 * 60
        following: dict[int, np.ndarray] = {}
        for part in _runs(open_nodes, per_node):
            seen = (1 << depth) - 1
            level = _Level(growth, depth, feature[:, :seen + 1], cut[:, :seen + 1], part, features, tried, edges, {}, {t: weight[t] for t in part if t in weight})
            if growth.random_cuts:
                for t, (f, c) in _job(rows, level, _ranges, _choose_cuts, ("low", "high"), ("feature", "cut")).items():
                    shape = (len(part[t]), -1)
                    level.chosen[t] = np.frombuffer(f, np.int32).reshape(shape), np.frombuffer(c, np.float64).reshape(shape)
                level.open = {t: nodes for t, nodes in part.items() if t in level.chosen}
            for t, packed in _job(rows, level, _sums, _divide, ("value",), tuple(_DIVISION)).items():
                found = {c: np.frombuffer(p, kind) for p, (c, kind) in zip(packed, _DIVISION.items())}
                nodes, total, left = level.open[t], found["total"].reshape(-1, 3), found["left"].reshape(-1, 3)
                w = weight.setdefault(t, balanced(total[0, 1:]))
                feature[t, nodes], cut[t, nodes] = found["feature"], found["cut"]
                probability[t, nodes] = _share(total, w)
                divided = found["feature"] >= 0
                np.add.at(importance[t], found["feature"][divided], found["gain"][divided])
                children = []
                for child, counts in ((2 * nodes[divided] + 1, left[divided]), (2 * nodes[divided] + 2, (total - left)[divided])):
                    probability[t, child] = _share(counts, w)
                    wide = (counts[:, 0] >= 2 * growth.min_leaf) & (counts[:, 1] > 0) & (counts[:, 2] > 0)
                    children.append(child[wide])
                children = np.sort(np.concatenate(children))
                if len(children):
                    following[t] = children
        open_nodes = following
    with np.errstate(invalid="ignore"):
        by_tree = np.nan_to_num(importance / importance.sum(axis=1, keepdims=True))
    mean = by_tree.mean(axis=0)
    return Ensemble(feature, cut, probability, mean / mean.sum() if mean.sum() else mean)


def _share(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    weighted = counts[:, 1:] * weight
    total = weighted.sum(axis=1)
    return np.divide(weighted[:, 1], total, out=np.zeros(len(counts)), where=total > 0)


def _runs(open_nodes: dict[int, np.ndarray], node_bytes: int) -> Iterator[dict[int, np.ndarray]]:
    """The trees in runs that take ``LEVEL_BYTES`` at most; one tree always fits."""
    run: dict[int, np.ndarray] = {}
    used = 0
    for t, nodes in open_nodes.items():
        need = len(nodes) * node_bytes
        if run and used + need > LEVEL_BYTES:
            yield run
            run, used = {}, 0
        run[t] = nodes
        used += need
    if run:
        yield run


def predicted(ensemble: Ensemble, df: DataFrame, cells: Column, name: str) -> DataFrame:
    """``df`` with the ensemble's probability; ``cells`` is an array of as many numbers as the ensemble has features."""
    sent = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        return pa.array(sent.value.predict(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)))

    return df.withColumn(name, probability(cells))
