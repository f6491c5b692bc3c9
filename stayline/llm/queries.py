"""The training-data operators as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import chat, decontaminate, divergence, fim, line_dedup, lm_scoring, mixing, neighbour_votes, quality, sharding, simhash, token_records, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary() -> token_records.Vocabulary:
    import public_tokenizers

    return token_records.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op1_token_records(spark: SparkSession, folder: str) -> DataFrame:
    written = token_records.write_tokens(_table(spark, folder, "documents"), _vocabulary())
    return token_records.token_digests(spark, written)


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    written = warc.write_warc(_table(spark, folder, "pages"))
    return warc.read_warc(spark, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.replicate(_table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scoring.score(_table(spark, folder, "documents"), _vocabulary())
    mean = F.col("log_score") / F.col("n_tokens")
    return scored.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


def op7_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality.ledger(docs).select(
        "doc_id",
        *quality.MEASUREMENTS,
        "failed_rules",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STANDARD).alias("kept"),
    )


def op8_rotate_chat(spark: SparkSession, folder: str) -> DataFrame:
    rotated = chat.rotate(_table(spark, folder, "conversations"))
    places = ("conv_id", "perspective", "part", "at_turn", "piece", "n_messages", "opening_chars")
    return rotated.select(*places, "text", chat.spans_text().alias("target_spans"))


def op9_shard(spark: SparkSession, folder: str) -> DataFrame:
    value = F.coalesce("text", F.lit(""))
    sized = _table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(value) + F.lit(8).cast("long")).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32")
    )
    placed = sharding.assign(sized, order=("doc_id",), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    gone = line_dedup.repeated_lines(_table(spark, folder, "documents"), least_equal=1)
    return gone.select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "distance")


def op11_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return neighbour_votes.classify(docs, _table(spark, folder, "labels")).drop("text")


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    made = fim.rearrange(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    return fim.restore(made).drop("output", "restored")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_token_records, op2_decontaminate, op3_warc, op4_mix_sources, op5_simhash,
        op6_lm_score, op7_quality_ledger, op8_rotate_chat, op9_shard, op10_line_dedup, op11_quality_votes, op12_fill_in_middle, op13_source_divergence,
    )
    return {query.__name__: query for query in found}
