"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# where the running job keeps its intermediates
WORK_FOLDER = "stayline.work.folder"

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "stayline", settings: dict[str, str] | None = None) -> SparkSession:
    """Session with the SQL settings the jobs rely on; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SQL_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for durable intermediates: that of the running job, else the session's ``spark.checkpoint.dir``.

    Where neither is set, a local master uses a folder of the warehouse; on a cluster nothing tells whether the
    warehouse is shared, so the setting must be given.
    """
    folder = spark.conf.get(WORK_FOLDER, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


@contextmanager
def work_folder(spark: SparkSession, parent: str) -> Iterator[str]:
    """A folder below ``parent`` for the intermediates of one job, made before and removed after it.

    That it can be made is known before the job writes anything else.
    """
    path = f"{parent.rstrip('/')}/_work-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.mkdirs(place):
        raise OSError(f"cannot make the work folder {path}")
    before = spark.conf.get(WORK_FOLDER, None)
    spark.conf.set(WORK_FOLDER, path)
    try:
        yield path
    finally:
        spark.conf.unset(WORK_FOLDER) if before is None else spark.conf.set(WORK_FOLDER, before)
        store.delete(place, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files rather than re-running the plan, and every
    reader sees the same rows even where the plan has a sampled range exchange.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stayline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows in one partition, however many cores the cluster has."""
    return spark.createDataFrame(rows, schema).coalesce(1)
