"""Mixing sources to target weights by Poisson replication.

Each document of a source is repeated a number of times that is drawn from a Poisson distribution whose mean is
the source's target repetition rate. The draw inverts the distribution at a uniform number
hashed from seed and document id, so it needs no state and gives the same mix again. Built-in SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import stored

#: A greater rate is drawn as the sum of draws of at most this rate each: exp(-rate) must stay well above the smallest double.
DRAW_RATE = 500.0
#: Up to this many sources (one name and one number each) the rates are sent to every task.
SENT_SOURCES = 10_000
#: A uniform number has 52 random bits.
_DIGITS = 13


@dataclass(frozen=True)
class Mix:
    """Target shares of the text bytes. ``weights`` names sources and their shares (any scale); without them a source
    weighs its bytes to the power ``exponent``. ``epochs`` is the size of the mix in sizes of the input."""

    weights: tuple[tuple[str, float], ...] = ()
    exponent: float = 0.7
    epochs: float = 1.0
    seed: str = "mix-1"


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(1 << 4 * _DIGITS))


def rates(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """Columns source, bytes, rate: by how much each source is repeated on average.

    bytes counts one more for each document, so that no source weighs nothing. Null is a source of its own. With
    ``weights`` given, a source that they don't name has rate 0.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + F.lit(1).cast("long")).alias("bytes")
    )
    if mix.weights:
        named = docs.sparkSession.createDataFrame(list(mix.weights), "source string, weight double").coalesce(1)
        sizes = sizes.join(named, sizes["source"].eqNullSafe(named["source"]), "left").select(
            sizes["source"], "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    else:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(mix.exponent)))
    sizes = stored(sizes, "sources")
    total = sizes.agg(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double").alias("weight"), F.sum("bytes").alias("bytes")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0)
    rate = F.lit(mix.epochs) * share * F.lit(total["bytes"] or 0) / F.col("bytes")
    return sizes.select("source", "bytes", F.round(rate, 9).alias("rate"))


def _steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... repetitions, up to where the rest cannot be drawn."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["steps"], F.array(c)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda state: state["steps"])


def replicate(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mixed documents in shuffled order: every row of ``docs`` as often as drawn, with copy (from 0) and
    mix_key (hash that orders the mix). Columns of ``docs`` with these names are replaced.

    Equal doc_ids draw equal numbers; rows without an id draw by their text. A rate above ``DRAW_RATE`` is a sum of independent
    draws of equal parts of it, which is Poisson too, so a source of one byte beside a large corpus gets its many copies. Null
    and empty texts are repeated like others. An empty table gives no rows.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "mix_key")]).alias("doc")
    known = stored(rates(docs, mix, text, source), "rates")
    parts = F.greatest(F.ceil(F.col("rate") / DRAW_RATE), F.lit(1)).cast("int")
    steps = known.select(F.col("source").alias("_source"), parts.alias("_parts"), _steps(F.col("rate") / parts).alias("_steps"))
    if known.count() <= SENT_SOURCES:
        steps = F.broadcast(steps)
    name = lambda at: F.coalesce(F.col(f"{at}`{doc_id}`").cast("string"), F.col(f"{at}`{text}`"), F.lit("null"))
    count = lambda u: F.size(F.filter("_steps", lambda c: c <= u))
    part_of = lambda k: _uniform(F.lit(mix.seed), F.lit("part"), k.cast("string"), name("doc."))
    summed = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, k: n + count(part_of(k)))
    drawn = F.when(F.col("_parts") == 1, count(F.col("_u"))).otherwise(summed)
    last = F.col("_n") - 1
    return (
        docs.select(own, F.col(f"`{source}`").alias("_by"), _uniform(F.lit(mix.seed), name("")).alias("_u"))
        .join(steps, F.col("_by").eqNullSafe(F.col("_source")))
        .withColumn("_n", drawn)
        .where("_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("copy").cast("string"), name("doc."))))
        .select("doc", "copy", "mix_key", F.monotonically_increasing_id().alias("_tie"))
        .repartitionByRange("mix_key", "_tie")
        .sortWithinPartitions("mix_key", "_tie")
        .select("doc.*", "copy", "mix_key")
    )
