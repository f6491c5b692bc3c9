"""Exact order statistics by radix selection, without ordering all rows.

Values fall into buckets that keep their order: by leading bits (whole numbers) or by sign and magnitude (fractions). Counts
by bucket tell which bucket holds a wanted rank and how many values lie below it; the values of that bucket alone are divided
again, evenly between its least and its greatest, until a bucket holds one value or few enough rows to count value by value.
All targets share each pass. Counts are whole numbers and comparisons are on the values themselves, so results are exact for
64-bit integers, decimals and doubles alike.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.session import small_table

# buckets of one division
BUCKETS = 4096
# leading bits of a whole number that make its first bucket
LEADING = 12
# a bucket with so many rows at most is counted value by value
FEW = 20_000
# counts are merged within so many classes of the partition number first, so that no task meets one row from every other
MERGED = 32
# first buckets of fractions: two for each power of two, offset so that magnitudes are positive
MOST_LOG, OFFSET = 1100.0, 2200


@dataclass(frozen=True)
class Target:
    """Wanted ranks of a column: numbers from 1, as a function of how many values it has."""

    name: str
    value: Column
    ranks: Callable[[int], Sequence[int]]


@dataclass(frozen=True)
class Found:
    """The value at a rank, how many values are smaller, how many are equal, and how many there are in all."""

    value: object
    before: int
    equal: int
    total: int


@dataclass(frozen=True)
class _Part:
    """A stretch of a target's values that holds a wanted rank: its least and greatest, the rows before it and in it."""

    low: object
    high: object
    before: int
    n: int


def _first_bucket(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType):
        return F.shiftright(value, 64 - LEADING).cast("long")
    number = value.cast("double")
    # logarithms keep order, as do the other steps
    size = F.floor(2 * F.least(F.log2(F.abs(number)), F.lit(MOST_LOG))) + OFFSET
    return F.when(number == 0, F.lit(0).cast("long")).when(number > 0, size).otherwise(-size)


def _even_bucket(value: Column, low: Column, high: Column) -> Column:
    """Division of low to high into equal widths; low and high never share a bucket."""
    return F.least(F.floor((value - low) / (high - low) * BUCKETS).cast("long"), F.lit(BUCKETS - 1).cast("long"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with n, its least and its greatest value: by task, by class of partitions, and once."""
    within = rows.withColumn("part", F.spark_partition_id() % MERGED).groupBy("part", *keys)
    first = within.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return first.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _stacked(df: DataFrame, targets: list[Target]) -> tuple[DataFrame, T.DataType]:
    """(target, value): the values of all targets below each other, nulls left out, and their type."""
    kinds = df.select(*[t.value.alias(f"v{i}") for i, t in enumerate(targets)]).schema
    (kind,) = {f.dataType for f in kinds}
    if isinstance(kind, T.IntegralType):
        kind = T.LongType()
    elif isinstance(kind, T.FloatType):
        kind = T.DoubleType()
    elif not isinstance(kind, T.FractionalType):
        raise TypeError(f"no order statistics of {kind.simpleString()}")
    entries = F.array(*[F.struct(F.lit(i).alias("target"), t.value.cast(kind).alias("value")) for i, t in enumerate(targets)])
    return df.select(F.inline(entries)).where(F.col("value").isNotNull()), kind


def _by_part(found: DataFrame) -> dict[int, list]:
    """Buckets of each part in their order; at most ``BUCKETS`` or so for a part."""
    out: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["part"], r["bucket"])):
        out.setdefault(r["part"], []).append(r)
    return out


def values_at_ranks(df: DataFrame, targets: list[Target]) -> dict[str, list[Found]]:
    """For each target what is at its ranks, in the order given; a target without values is left out.

    All target columns have one numeric type; nulls are no values, and callers exclude NaN. ``df`` is read two to seven times, so
    store it first. What reaches the driver in a pass is at most one row for each bucket and target, and a row for each wanted rank goes
    back; callers pass a target for each feature, class or boundary.
    """
    if not targets:
        return {}
    spark = df.sparkSession
    rows, kind = _stacked(df, targets)

    first = _by_part(
        _counted(rows.withColumn("bucket", _first_bucket(F.col("value"), kind)), ["target", "bucket"]).withColumnRenamed("target", "part")
    )
    totals = {i: sum(r["n"] for r in buckets) for i, buckets in first.items()}
    wanted = sorted({(i, rank) for i, n in totals.items() for rank in targets[i].ranks(n)})
    for i, rank in wanted:
        if not 1 <= rank <= totals[i]:
            raise ValueError(f"rank outside the column: {targets[i].name}")

    def holding(buckets: list, rank: int, before: int) -> _Part:
        ends = list(accumulate(r["n"] for r in buckets))
        at = bisect_left(ends, rank - before)
        return _Part(buckets[at]["low"], buckets[at]["high"], before + ends[at] - buckets[at]["n"], buckets[at]["n"])

    def inside(parts: list[tuple[int, int]]) -> DataFrame:
        """(part, value, low, high): the rows of each part, a stretch of a target's values."""
        at = {(i, p.before): p for (i, _), p in place.items()}
        known = [(k, i, at[i, b].low, at[i, b].high) for k, (i, b) in enumerate(parts)]
        sent = small_table(spark, known, f"part int, of int, low {kind.simpleString()}, high {kind.simpleString()}")
        same = (F.col("target") == F.col("of")) & F.col("value").between(F.col("low"), F.col("high"))
        return rows.join(F.broadcast(sent), same).select("part", "value", "low", "high")

    place = {(i, rank): holding(first[i], rank, 0) for i, rank in wanted}
    while wide := sorted({(i, p.before) for (i, _), p in place.items() if p.n > FEW and p.low != p.high}):
        bucket = _even_bucket(F.col("value"), F.col("low"), F.col("high"))
        divided = inside(wide).withColumnRenamed("part", "of_part").withColumn("bucket", bucket).select("of_part", "bucket", "value")
        found = _by_part(_counted(divided, ["of_part", "bucket"]).withColumnRenamed("of_part", "part"))
        for (i, rank), p in place.items():
            if (i, p.before) in wide:
                place[i, rank] = holding(found[wide.index((i, p.before))], rank, p.before)

    done = {at: Found(p.low, p.before, p.n, totals[at[0]]) for at, p in place.items() if p.low == p.high}
    rest = sorted({(i, p.before) for (i, rank), p in place.items() if (i, rank) not in done})
    if rest:
        # at most FEW rows of each part, so one count does
        through = F.sum("n").over(Window.partitionBy("of_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        few = inside(rest).groupBy(F.col("part").alias("of_part"), "value").agg(F.count(F.lit(1)).alias("n"))
        counted = few.withColumn("through", through)
        asked = [(rest.index((i, place[i, rank].before)), rank - place[i, rank].before, i, rank) for i, rank in wanted if (i, rank) not in done]
        sent = small_table(spark, [(at, k, r) for at, (k, r, _, _) in enumerate(asked)], "at int, k int, place bigint")
        hit = (F.col("of_part") == F.col("k")) & (F.col("through") >= F.col("place")) & (F.col("through") - F.col("n") < F.col("place"))
        for r in counted.join(F.broadcast(sent), hit).select("at", "value", "n", "through").collect():
            _, _, i, rank = asked[r["at"]]
            done[i, rank] = Found(r["value"], place[i, rank].before + r["through"] - r["n"], r["n"], totals[i])
    return {targets[i].name: [done[i, rank] for rank in targets[i].ranks(totals[i])] for i in sorted(first)}
