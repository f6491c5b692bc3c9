"""Shared storage: durable tables, files written by tasks, and numbered rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.session import shared_folder

#: monotonically_increasing_id() holds the partition above this many bits and the row's place below.
PLACE_BITS = 33


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor re-reads files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *keys: Column, partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, with its partition and its place there.

    Adds ``_part`` (int) and ``_place`` (long). Rows with equal keys are split by their place in the input,
    so one key may hold any share of the rows; the caller adds keys until equal rows are alike.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, F.col("_tie"))
        .sortWithinPartitions(*keys, F.col("_tie"))
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    )


def offsets(spark: SparkSession, sizes: dict[int, int], name: str) -> DataFrame:
    """``_part`` with the total of all partitions before it; one row for each partition."""
    rows, before = [], 0
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    return spark.createDataFrame(rows, f"_part int, {name} long").coalesce(1)


def numbered(df: DataFrame, *keys: Column, name: str = "row_number", partitions: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with its global row number from 0 in the order of ``keys``, and the number of rows.

    The sorted rows are stored first: both the count for each partition and the numbering must see the same
    sampled ranges. Only one count for each partition reaches the driver.
    """
    rows = stored(in_order(df, *keys, partitions=partitions), "ordered")
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = (
        rows.join(F.broadcast(offsets(df.sparkSession, sizes, "_before")), "_part")
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_part", "_place", "_before")
    )
    return out, sum(sizes.values())


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, in a task or on the driver; the file system of ``uri`` must be one
    that Arrow knows (local, S3, GCS, HDFS)."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class TaskFile:
    """One output file of one task attempt, under a temporary name until the driver commits it.

    A repeated or a lost attempt leaves a file that no manifest names.
    """

    def __init__(self, folder: str, name: str):
        store, root = open_store(folder)
        self.name = name
        self.temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
        store.create_dir(f"{root}/_temporary", recursive=True)
        self._stream = store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._stream.close()


def commit(folder: str, files: list[tuple[str, str]], manifest: bytes) -> None:
    """Give the files (temporary name, final name) their final names, then write the manifest last.

    Moving again a file that has already moved is skipped, so a commit that broke off can be repeated.
    """
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    for temporary, final in files:
        if store.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
            store.move(f"{root}/{temporary}", f"{root}/{final}")
    with store.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(manifest)
    store.move(f"{root}/_manifest.tmp", f"{root}/manifest.json")


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` has about ``most_bytes``; one longer row stays whole."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for at, length in enumerate(lengths):
            if total and total + length > most_bytes:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += length
        if start < batch.num_rows:
            yield batch.slice(start)
