"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself are linked to the smallest of them. ``a`` is larger than ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = edges.join(least, F.col("a") == F.col("k")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root for every node in ``edges`` (a, b of one type); root is the smallest node of its component.

    The pairs shrink to one star for each component. Each round is written to the shared folder and read back;
    only a count and two checksums reach the driver. A node with many neighbours is met through partial
    minima and joins, whose large partitions Spark splits. No pairs give no rows; pairs of a node
    with itself are ignored, repeated ones count once.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _state(current)
    while before[0]:
        large = _large_star(current).distinct()
        current = stored(_small_star(large).distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
