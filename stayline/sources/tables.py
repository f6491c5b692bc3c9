"""Reading the five business tables from CSV, Parquet or the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.columns import nan_to_null
from stayline.schemas import TABLES
from stayline.sources import records
from stayline.sources.sinks import current


# Cell texts that CSV readers of the pandas family take as "no value".
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

class MissingInput(FileNotFoundError):
    """An input table is not where it was looked for."""


def _typed(name: str, kind: T.DataType) -> Column:
    column = F.col(name)
    if isinstance(kind, T.IntegerType):
        # writers of nullable integers often emit "4.0"; a fraction is no count and becomes NULL
        number = column.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int")).alias(name)
    return column.try_cast(kind).alias(name)


def conform(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Give the columns that are present their declared type, matching by name.

    Column order does not matter, columns may be absent, and unreadable values become NULL.
    Columns outside the schema are kept as read.
    """
    kinds = {field.name: field.dataType for field in schema.fields}
    return raw.select([_typed(c, kinds[c]) if c in kinds else F.col(c) for c in raw.columns])


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool | None = None,
    missing: tuple[str, ...] = MISSING_MARKERS,
) -> DataFrame:
    """CSV with a header line. Values are read as text and cast by name, with no inference pass.

    Files are split among tasks, line breaks inside quotes or not. Whether there are any is looked up in one pass over the
    lines; ``multi_line`` true or false saves that pass.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    try:
        raw = reader.csv(path)
    except AnalysisException as error:
        raise MissingInput(f"Missing file: {path}") from error
    if multi_line or (multi_line is None and records.has_broken_lines(spark, path)):
        raw = records.parsed(records.records(spark, path), raw.columns)
    raw = raw.select([F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in raw.columns])
    return nan_to_null(conform(raw, schema))


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or the newest version of one that was written here."""
    try:
        return nan_to_null(spark.read.parquet(current(spark, path)))
    except AnalysisException as error:
        raise MissingInput(f"Missing file: {path}") from error


def read_catalog_table(spark: SparkSession, name: str) -> DataFrame:
    try:
        return nan_to_null(spark.table(name))
    except AnalysisException as error:
        raise MissingInput(f"Missing table: {name}") from error


def load_tables(spark: SparkSession, location: str, fmt: str = "csv", prefix: str = "") -> dict[str, DataFrame]:
    """The five tables as ``<location>/<prefix><table>.<fmt>``, or ``<location>.<prefix><table>``
    for ``fmt="catalog"``."""
    if fmt == "catalog":
        return {t: read_catalog_table(spark, f"{location}.{prefix}{t}") for t in TABLES}
    if fmt == "parquet":
        return {t: read_parquet_table(spark, f"{location}/{prefix}{t}.parquet") for t in TABLES}
    if fmt == "csv":
        return {t: read_csv_table(spark, f"{location}/{prefix}{t}.csv", s) for t, s in TABLES.items()}
    raise ValueError(f"unknown format {fmt!r}")


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Make the tables reachable from ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_cols"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, n: int = 3, order_by: str | None = None) -> DataFrame:
    """A few rows to look at; with ``order_by``, the same ones every time."""
    return (df if order_by is None else df.orderBy(order_by)).limit(n)
