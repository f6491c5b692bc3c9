"""Writing results.

A table is replaced without a gap: every write makes a new version folder and marks it complete last, and readers take the
newest complete one (``current``). A job that fails half-way leaves the earlier table as it was. The version before the newest
stays for readers that have begun with it; older ones are removed.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

COMPLETE = "_COMPLETE"
_VERSION = re.compile(r"v(\d{8,})-[0-9a-f]{32}")

# keys by which the business tables are stored together
BUCKET_KEYS = {
    "accounts": "account_id", "subscriptions": "account_id", "support_tickets": "account_id", "churn_events": "account_id",
    "feature_usage": "subscription_id",
}


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> dict[int, list[tuple[str, bool]]]:
    """Version folders by number, each with whether it is complete; several writers may take one number."""
    store, place = _store(spark, path)
    found: dict[int, list[tuple[str, bool]]] = {}
    if not store.exists(place):
        return found
    for entry in store.listStatus(place):
        name = entry.getPath().getName()
        if match := _VERSION.fullmatch(name):
            folder = f"{path}/{name}"
            found.setdefault(int(match[1]), []).append((folder, store.exists(_store(spark, f"{folder}/{COMPLETE}")[1])))
    return found


def current(spark: SparkSession, path: str) -> str:
    """Where the table written to ``path`` lies now: its newest complete version, or ``path`` itself if it has no versions."""
    path = path.rstrip("/")
    complete = {n: sorted(f for f, done in folders if done) for n, folders in _versions(spark, path).items()}
    newest = max((n for n, folders in complete.items() if folders), default=None)
    return path if newest is None else complete[newest][-1]


def publish(df: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None]) -> str:
    """Write a new version of the table at ``path`` and make it the current one; its folder is returned."""
    spark, path = df.sparkSession, path.rstrip("/")
    before = _versions(spark, path)
    folder = f"{path}/v{max(before, default=0) + 1:08d}-{uuid.uuid4().hex}"
    save(df.write, folder)
    store, mark = _store(spark, f"{folder}/{COMPLETE}")
    store.create(mark, True).close()
    kept = max((n for n, folders in before.items() if any(done for _, done in folders)), default=0)
    for n, folders in before.items():
        for old, _ in folders:
            if n < kept:
                store.delete(_store(spark, old)[1], True)
    return folder


def write_master(master: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Master table, replacing an earlier one."""
    options = {"header": True} if fmt == "csv" else {}
    return publish(master, path, lambda writer, to: writer.options(**options).format(fmt).save(to))


def write_scored(scored: DataFrame, path: str) -> str:
    """Scored accounts, one folder per priority class (P1 to P4) so readers can prune."""
    classed = scored.withColumn("priority_class", F.substring("retention_priority", 1, 2))
    return publish(classed, path, lambda writer, to: writer.partitionBy("priority_class").parquet(to))


def write_actions(actions: DataFrame, path: str) -> str:
    """The short action list as one CSV file with a header."""
    return publish(actions.coalesce(1), path, lambda writer, to: writer.option("header", True).csv(to))


def write_small(df: DataFrame, path: str) -> str:
    """A report or chart data set."""
    return publish(df, path, lambda writer, to: writer.parquet(to))


def write_bucketed(tables: dict[str, DataFrame], database: str, buckets: int, prefix: str = "") -> None:
    """The business tables as catalog tables dealt and sorted by the key they are joined on.

    Reading them from the catalog, the summaries of accounts and the joins of the master table need no exchange by account; usage is
    reduced to subscriptions without one. Take about one bucket for each 200 MB of the largest table.
    """
    for name, df in tables.items():
        key = BUCKET_KEYS[name]
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{prefix}{name}")
