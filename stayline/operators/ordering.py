"""Exact order-based results without sorting everything in one task.

``slice_in_order`` cuts a table into contiguous slices of a total order with one range exchange and
writes them down. What lies before a slice then follows from the slice totals, of which there are
at most (number of slices + number of groups), so ranks, quantiles and running totals need no
global window. The order columns must be unique within a group: callers with repeated values
count them first, which also removes the skew a frequent value would cause.

A rank is a function that writes the SQL of the rank from that of the group's total weight; ranks count from 1.
Slice totals are sent to every task: one for each slice, and one for each slice and group where a slice holds several
groups. Callers group by a label, a class or a feature only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import durable

SLICE = "_slice"

Rank = Callable[[str], str]


@dataclass(frozen=True)
class Sliced:
    """A stored table whose slices are contiguous in ``order_by`` within each group."""

    rows: DataFrame
    order_by: tuple[str, ...]
    group_by: tuple[str, ...]
    descending: bool

    def order(self) -> list[Column]:
        direction = F.desc if self.descending else F.asc
        return [direction(name) for name in self.order_by]


def slice_in_order(
    df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), descending: bool = False
) -> Sliced:
    """Range-partition by group and order, and store the result with its slice number."""
    shape = Sliced(df, tuple(order_by), tuple(group_by), descending)
    rows = df.repartitionByRange(*map(F.asc, group_by), *shape.order()).withColumn(
        SLICE, F.spark_partition_id()
    )
    return Sliced(durable(rows, "slices"), shape.order_by, shape.group_by, descending)


def _slice_bounds(sliced: Sliced, weights: Sequence[str]) -> DataFrame:
    """Weight before each slice, in it, and of its whole group; few rows, see the module text."""
    group = f"partition by {', '.join(sliced.group_by)}" if sliced.group_by else ""
    columns = []
    for w in weights:
        columns += [
            f"{w}_inside",
            f"coalesce(sum({w}_inside) over ({group} order by {SLICE} rows between unbounded preceding "
            f"and 1 preceding), 0) as {w}_before",
            f"sum({w}_inside) over ({group}) as {w}_total",
        ]
    return (
        sliced.rows.groupBy(*sliced.group_by, SLICE)
        .agg(*[F.sum(w).alias(f"{w}_inside") for w in weights])
        .selectExpr(*sliced.group_by, SLICE, *columns)
    )


def _within(ranks: Sequence[Rank], total: str, before: str, through: str) -> str:
    """SQL test: one of the ranks lies in (before, through]."""
    places = [rank(total) for rank in ranks]
    return " or ".join(f"({place} > {before} and {place} <= {through})" for place in places)


def running_totals(sliced: Sliced, weights: Sequence[str], ranks: Sequence[Rank] | None = None) -> DataFrame:
    """Add ``<weight>_through``, the inclusive running total, and ``<weight>_total`` of the group.

    With ``ranks``, slices that hold none of these ranks of the first weight are left out.
    """
    bounds = _slice_bounds(sliced, weights)
    if ranks is not None:
        w = weights[0]
        bounds = bounds.filter(_within(ranks, f"{w}_total", f"{w}_before", f"({w}_before + {w}_inside)"))
    in_slice = (
        Window.partitionBy(*sliced.group_by, SLICE)
        .orderBy(*sliced.order())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.rows.join(F.broadcast(bounds), [*sliced.group_by, SLICE])
        .withColumns({f"{w}_through": F.col(f"{w}_before") + F.sum(w).over(in_slice) for w in weights})
        .drop(*[f"{w}_{part}" for w in weights for part in ("inside", "before")])
    )


def at_ranks(sliced: Sliced, weight: str, ranks: dict[str, Rank]) -> DataFrame:
    """One row per group: under each name the order columns found at that rank, and the total.

    A rank outside the group finds NULL.
    """
    near = running_totals(sliced, [weight], list(ranks.values()))
    total, through = f"{weight}_total", f"{weight}_through"
    found = [
        F.expr(
            f"max(case when {_within([rank], total, f'({through} - {weight})', through)} "
            f"then struct({', '.join(sliced.order_by)}) end)"
        ).alias(name)
        for name, rank in ranks.items()
    ]
    return near.groupBy(*sliced.group_by).agg(*found, F.max(total).alias(total))


def keys_at_places(df: DataFrame, key: str, wanted: dict[str, tuple[Column, int]]) -> dict[str, object]:
    """Under each name, the key at a place (from 1) among the rows that meet a condition, all names in one range exchange.

    Conditions may overlap. A key counts as often as it occurs; copies are counted first.
    """
    if not wanted:
        return {}
    name = F.array(*[F.when(condition, F.lit(at)) for at, (condition, _) in enumerate(wanted.values())])
    rows = df.select(F.explode(F.filter(name, lambda n: n.isNotNull())).alias("_wanted"), F.col(key).alias("_key"))
    counted = rows.groupBy("_wanted", "_key").agg(F.count(F.lit(1)).alias("n"))
    places = {str(at): (lambda total, p=place: str(p)) for at, (_, place) in enumerate(wanted.values())}
    found = at_ranks(slice_in_order(counted, ["_key"], ["_wanted"]), "n", places).collect()
    by_name = {r["_wanted"]: r[str(r["_wanted"])]["_key"] for r in found}
    return {label: by_name[at] for at, label in enumerate(wanted)}


def quantiles(sliced: Sliced, weight: str, shares: dict[str, Fraction]) -> DataFrame:
    """Exact quantiles of the one order column, linear between neighbours; one row per group."""
    (value,) = sliced.order_by
    ranks: dict[str, Rank] = {}
    columns: list[str] = []
    for name, share in shares.items():
        top, bottom = share.numerator, share.denominator
        ranks[f"{name}_low"] = lambda total, t=top, b=bottom: f"(floor(({total} - 1) * {t} / {b}) + 1)"
        ranks[f"{name}_high"] = lambda total, t=top, b=bottom: f"(ceil(({total} - 1) * {t} / {b}) + 1)"
        low, high = (f"cast({name}_{end}.{value} as double)" for end in ("low", "high"))
        part = f"(({weight}_total - 1) * {top} % {bottom} / {bottom})"
        columns.append(f"{low} + ({high} - {low}) * {part} as {name}")
    return at_ranks(sliced, weight, ranks).selectExpr(*sliced.group_by, *columns)
