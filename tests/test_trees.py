import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.learning import logistic, trees
from stayline.session import durable


def sample(n, seed=1, features=7):
    """Features of several kinds: numbers, many ties, a flag, a constant, noise."""
    draw = np.random.default_rng(seed)
    cells = np.stack([
        draw.normal(0, 1, n), draw.integers(0, 4, n), draw.integers(0, 2, n), np.full(n, 3.0), draw.exponential(1e4, n),
        draw.integers(0, 2, n), draw.normal(5, 2, n),
    ], axis=1).astype(float)[:, :features]
    label = (cells[:, 0] + cells[:, 1] / 3 + draw.normal(0, 0.6, n) > 0.9).astype(int)
    return cells, label


def table(spark, cells, label, parts=4):
    rows = [(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(cells, label))]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>")
    dealt = df.select(F.xxhash64("id").alias("row_hash"), "label", F.col("x").alias("cells"))
    return durable(dealt.repartition(parts, "row_hash"), "rows"), {r.id: np.int64(r.h).view(np.uint64) for r in df.select("id", F.xxhash64("id").alias("h")).collect()}


def gini(weighted):
    total = weighted.sum()
    return total - (weighted**2).sum() / total if total else 0.0


def plain_tree(growth, tree, cells, label, hashes, edges):
    """One tree, node by node, rows in lists: {node: (feature, cut)} and {node: probability}."""
    features = cells.shape[1]
    times = trees.draws(growth.seed, tree, hashes) if growth.bootstrap else np.ones(len(label), int)
    drawn = np.array([times[label == c].sum() for c in (0, 1)])
    weight = np.array([drawn.sum() / (2 * d) for d in drawn])
    tried = int(features**0.5)
    divisions, shares = {}, {}

    def counts(rows):
        return np.array([times[rows][label[rows] == c].sum() for c in (0, 1)]) * weight

    def visit(node, rows, depth):
        own = counts(rows)
        shares[node] = own[1] / own.sum()
        if depth == growth.max_depth or len(rows) < 2 * growth.min_leaf or 0 in own:
            return
        order = sorted(range(features), key=lambda f: int(trees.mixed(trees.ORDER, growth.seed, tree, node, f)[0]))[: trees.POOL * tried]
        varying = [f for f in order if len(set(cells[rows, f])) > 1]
        best = None
        if growth.random_cuts:
            order = (varying + [f for f in order if f not in varying])[:tried]
            candidates = []
            for f in order:
                low, high = cells[rows, f].min(), cells[rows, f].max()
                if low < high:
                    share = float(trees.uniform(trees.CUT, growth.seed, tree, node, f)[0])
                    candidates.append((f, min(low + share * (high - low), np.nextafter(high, -np.inf))))
        else:
            binned = [f for f in order if len({int(np.searchsorted(edges[f], v)) for v in cells[rows, f]}) > 1][:tried]
            candidates = [(f, cut) for f in order if f in binned for cut in edges[f]]
        for f, cut in candidates:
            left, right = rows[cells[rows, f] <= cut], rows[cells[rows, f] > cut]
            if min(len(left), len(right)) < growth.min_leaf:
                continue
            rest = gini(counts(left)) + gini(counts(right))
            if best is None or rest < best[0] - 1e-9:
                best = rest, f, cut, left, right
        if best:
            _, f, cut, left, right = best
            divisions[node] = f, cut
            visit(2 * node + 1, left, depth + 1)
            visit(2 * node + 2, right, depth + 1)

    visit(0, np.flatnonzero(times > 0), 0)
    return divisions, shares


@pytest.mark.parametrize("growth", [trees.extra_trees(6, max_depth=5), trees.forest(6, max_depth=5, bins=8)], ids=["extra", "forest"])
def test_every_node_equals_a_plain_tree(spark, growth):
    cells, label = sample(400)
    rows, by_id = table(spark, cells, label)
    hashes = np.array([by_id[i] for i in range(len(label))])
    grown = trees.grow(rows, cells.shape[1], growth)
    edges = trees.bin_edges(rows, cells.shape[1], growth.bins)
    for t in range(growth.trees):
        divisions, shares = plain_tree(growth, t, cells, label, hashes, edges)
        got = {int(n): (int(grown.feature[t, n]), float(grown.cut[t, n])) for n in np.flatnonzero(grown.feature[t] >= 0)}
        assert got == {n: (f, pytest.approx(c)) for n, (f, c) in divisions.items()} and len(got) > 4
        for node, share in shares.items():
            assert grown.probability[t, node] == pytest.approx(share)
    assert grown.importance.sum() == pytest.approx(1) and grown.importance[0] > 0.2 and grown.importance[3] == 0


@pytest.mark.parametrize("growth", [trees.extra_trees(5, max_depth=4), trees.forest(5, max_depth=4)], ids=["extra", "forest"])
def test_layout_does_not_matter(spark, growth, monkeypatch):
    cells, label = sample(900, 3)
    found = []
    for parts, level_bytes in ((1, 1 << 28), (16, 1 << 28), (64, 60_000)):
        monkeypatch.setattr(trees, "LEVEL_BYTES", level_bytes)
        found.append(trees.grow(table(spark, cells, label, parts)[0], cells.shape[1], growth))
    for other in found[1:]:
        assert (found[0].feature == other.feature).all() and (found[0].cut == other.cut).all()
        assert (found[0].probability == other.probability).all()
    again = trees.grow(table(spark, cells, label, 3)[0], cells.shape[1], trees.Growth(**{**growth.__dict__, "seed": 43}))
    assert (again.feature != found[0].feature).any()


def test_draws_and_weights_of_a_bootstrap():
    hashes = trees.mixed(np.arange(20_000))
    label = np.arange(20_000) % 9 == 0
    for t in range(5):
        times = trees.draws(42, t, hashes)
        assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.02
        drawn = np.array([times[~label].sum(), times[label].sum()])
        assert (drawn * trees.balanced(drawn)).sum() == pytest.approx(times.sum())
        assert (drawn * trees.balanced(drawn))[0] == pytest.approx(times.sum() / 2)
    assert (trees.draws(42, 0, hashes) != trees.draws(42, 1, hashes)).any()


@pytest.mark.parametrize("growth", [trees.extra_trees(3), trees.forest(3)], ids=["extra", "forest"])
def test_few_rows_and_one_class(spark, growth):
    cells, label = sample(5, 2)
    for y, want in ((np.zeros(5, int), 0.0), (np.ones(5, int), 1.0)):
        got = trees.grow(table(spark, cells, y)[0], 7, growth)
        drawn = got.probability[:, 0]
        assert (got.feature == -1).all() and set(drawn) <= {want, 0.0} and got.importance.sum() == 0
    empty = trees.grow(table(spark, cells, label)[0].where("false"), 7, growth)
    assert (empty.predict(cells) == 0).all()


def test_tasks_are_sized_by_rows(spark, monkeypatch):
    df = spark.range(5000).select("id", F.lit(1).alias("y"), F.array(F.lit(1.0)).alias("x"))
    parts = lambda: trees.training_rows(df, 5000, F.col("id"), F.col("y"), F.col("x")).rdd.getNumPartitions()
    assert parts() == 5
    monkeypatch.setattr(trees, "MOST_TASK_ROWS", 100)
    assert parts() == 50


def test_chunks_hold_so_many_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trees, "CHUNK_ROWS", 40)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array([1] * (b - a)), pa.array([[float(i), 0.0] for i in range(a, b)])], ["h", "l", "c"]) for a, b in ((0, 5), (5, 30), (30, 130), (130, 131))]
    found = list(trees._chunks(iter(batches), 2))
    assert all(len(h) <= 40 for h, _, _ in found) and [int(x) for h, _, _ in found for x in h] == list(range(131))
    assert all((c[:, 0] == h).all() for h, _, c in found)


def weighted_rows(spark, cells, label, weight, parts=3):
    rows = [(int(y), float(w), x.tolist()) for x, y, w in zip(cells, label, weight)]
    return durable(spark.createDataFrame(rows, "label int, weight double, cells array<double>").repartition(parts), "weighted")


def test_logistic_gradient_vanishes(spark):
    cells, label = sample(600, 5)
    weight = np.where(label == 1, 2.5, 0.7)
    found = [logistic.fit(weighted_rows(spark, cells, label, weight, parts), 7, penalty_c=0.5) for parts in (1, 9)]
    assert np.allclose(found[0].weights, found[1].weights, rtol=1e-7)
    x, side = np.column_stack([cells, np.ones(600)]), np.where(label == 1, 1.0, -1.0)
    at = found[0].weights
    # the loss penalises the constant like every other slot
    gradient = at - 0.5 * x.T @ (weight * side / (1 + np.exp(side * (x @ at))))
    assert np.abs(gradient / np.abs(x).sum(axis=0)).max() < 1e-7 and found[0].gradient <= 1e-9 and found[0].passes < 30
    df = spark.createDataFrame([(x.tolist(),) for x in cells], "x array<double>")
    got = [r.p for r in logistic.predicted(found[0], df, F.col("x"), "p").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(x @ at))))


def test_logistic_on_separable_and_no_rows(spark):
    cells = np.array([[random.Random(i).random() + (i % 2) * 50] for i in range(60)])
    found = logistic.fit(weighted_rows(spark, cells, np.arange(60) % 2, np.ones(60)), 1)
    assert np.isfinite(found.weights).all() and found.gradient <= 1e-9
    nothing = logistic.fit(weighted_rows(spark, cells, np.arange(60) % 2, np.ones(60)).where("false"), 1)
    assert (nothing.weights == 0).all()


def held_batches(cells, label, hashes):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(label.astype(np.int32)), pa.array(list(cells))], ["h", "l", "c"])]


@pytest.mark.parametrize("growth", [trees.extra_trees(2), trees.forest(2, bins=8)], ids=["extra", "forest"])
def test_a_task_gives_small_sums_whatever_it_holds(monkeypatch, growth):
    cells, label = sample(600, 4)
    hashes = trees.mixed(np.arange(600) // 300)  # keys that repeat draw alike
    edges = [] if growth.random_cuts else [np.unique(np.quantile(c, np.arange(1, 8) / 8, method="lower")) for c in cells.T]
    level = trees._Level(growth, 0, np.full((2, 1), -1, np.int32), np.zeros((2, 1)), {t: np.zeros(1, np.int64) for t in (0, 1)}, 7, 2, edges)
    if growth.random_cuts:
        level.chosen = {t: (np.array([[0, 1]], np.int32), np.array([[-9.0, 1.5]])) for t in (0, 1)}
    found = []
    for chunk, held, part, bits in ((600, 600, 600, 18), (70, 150, 33, 18), (600, 600, 100, 7)):
        monkeypatch.setattr(trees, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(trees, "HELD_ROWS", held)
        monkeypatch.setattr(trees, "PART_ROWS", part)
        monkeypatch.setattr(trees, "_DRAW_BITS", bits)
        out = list(trees._sums(iter(held_batches(cells, label, hashes)), level))
        # counts below 65536 take two bytes, and nothing but counts is sent
        assert all(len(b.column(1)[0].as_py()) % 6 == 0 for b in out)
        divided = list(trees._divide((b for t in (0, 1) for b in out if b.column(0)[0].as_py() == t), level))
        found.append([b.to_pylist() for b in divided])
    assert found[0] and found[0] == found[1] == found[2]


def test_cuts_below_all_values_of_a_part_send_rows_above():
    cells = np.array([[5.0], [6.0], [7.0]])
    level = trees._Level(trees.extra_trees(1), 1, np.zeros((1, 1), np.int32), np.full((1, 1), 1.0), {0: np.array([1, 2])}, 1, 1)
    level.chosen = {0: (np.zeros((2, 1), np.int32), np.array([[0.0], [6.5]]))}
    (block,) = trees._blocks(iter(held_batches(cells, np.array([0, 1, 1]), trees.mixed(np.arange(3)))), level)
    slot, row, _ = trees._rows_of(level, 0, block[0])
    assert slot.tolist() == [1, 1, 1] and row.tolist() == [0, 1, 2]
    (out,) = trees._sums(iter(held_batches(cells, np.array([0, 1, 1]), trees.mixed(np.arange(3)))), level)
    assert np.frombuffer(out.column(1)[0].as_py(), np.uint16).reshape(2, 2, 3)[1].tolist() == [[3, 1, 2], [1, 0, 1]]
