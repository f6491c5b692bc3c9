"""Column helpers. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that exist in ``df``, in the given order."""
    return [name for name in names if name in df.columns]


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio; a zero or missing divisor gives NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean_of(column: Column) -> Column:
    """Mean over non-null values as one division of the sum.

    Integer and decimal inputs are summed exactly, so the result does not depend on task order.
    """
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def sum_or_zero(column: Column) -> Column:
    """Sum whose value is 0, not NULL, when the group holds no value."""
    return F.coalesce(F.sum(column), F.lit(0))


def rate_pct(flag: Column) -> Column:
    """Percentage of true among the non-null flags."""
    return mean_of(flag.cast("int")) * 100


def percent_1dp(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` of two counts, rounded half up to one decimal in whole numbers."""
    return F.floor(F.try_divide(2000 * part + whole, 2 * whole)) / 10.0


def cut(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval holding the value; NULL outside the edges."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], labels))):
        label = F.when((column > low) & (column <= high), F.lit(name)).otherwise(label)
    return label


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: one notion of missing from here on."""
    return df.withColumns({
        field.name: F.when(~F.isnan(field.name), F.col(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.FloatType, T.DoubleType))
    })


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and both infinities become NULL in every floating column."""
    return df.withColumns({
        field.name: F.when(F.abs(field.name) < float("inf"), F.col(field.name))
        for field in df.schema.fields
        if isinstance(field.dataType, (T.FloatType, T.DoubleType))
    })


def to_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text columns among ``names`` become doubles, unreadable text becomes NULL."""
    text = [f.name for f in df.schema.fields if f.name in set(names) and isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: F.col(name).try_cast("double") for name in text})


def flags_to_int(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Boolean columns among ``names`` become 0/1; a missing flag stays NULL."""
    return df.withColumns({name: F.col(name).cast("int") for name in present(df, names)})


def fill_zero(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=present(df, names))


def number_text(column: Column, decimals: int, thousands: bool = False) -> Column:
    """Fixed-decimal text, rounded half to even; ``nan`` when missing."""
    text = F.format_number(column.cast("double"), decimals)
    if not thousands:
        text = F.translate(text, ",", "")
    return F.coalesce(text, F.lit("nan"))


def usd_text(column: Column) -> Column:
    """Whole dollars with thousands separators."""
    return F.concat(F.lit("$"), number_text(column, 0, thousands=True))
