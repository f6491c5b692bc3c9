"""A corpus from raw documents to shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, whatever others there are and whatever their names;
an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import decontaminate, mixing, quality, sharding, simhash
from stayline.llm.storage import stored

SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps. Null and empty texts have too few words and go; repeated rows share their fate."""
    return quality.keep(docs, quality.STANDARD)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 3-word shingles, 3 bits.

    The one with the smallest id stays, one row of it if rows repeat. Texts without a word, null ones too, are equal to each other and
    form one group.
    """
    return simhash.keep_one(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none and stay; rows of equal texts share their fate."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order.

    A null source is one of its own. Rows that repeat an id are repeated equally often, and null texts like others.
    """
    return mixing.replicate(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with row_number, shard and slot, nulls first in the order of ids; equal rows have numbers of their own."""
    return sharding.assign(docs, shards=SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Fingerprints and edit distances have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
