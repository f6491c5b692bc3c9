"""Stratified train and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.ordering import keys_at_places
from stayline.operators.selection import Target, values_at_ranks
from stayline.session import durable

TEST_PARTS, ALL_PARTS = 1, 5  # one fifth is held out
SEED = 42


def held_out_sizes(labelled: DataFrame) -> DataFrame:
    """How many rows of each class are held out.

    The whole test set has ceil(n / 5) rows. Classes keep floor(n_class * n_train / n) training
    rows, and the rows still missing go to the classes with the largest remainders.
    """
    everything = Window.partitionBy()  # over one row per class
    n, all_n = F.col("n"), F.col("all_n")
    n_train = all_n - F.ceil(all_n * TEST_PARTS / ALL_PARTS)
    return (
        labelled.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("all_n", F.sum("n").over(everything))
        .withColumn("n_train", n_train)
        .withColumn("train", F.floor(n * F.col("n_train") / all_n))
        .withColumn("left_over", n * F.col("n_train") % all_n)
        .withColumn("missing", F.col("n_train") - F.sum("train").over(everything))
        .withColumn("turn", F.row_number().over(everything.orderBy(F.desc("left_over"), "label")))
        .withColumn("train", F.col("train") + F.when(F.col("turn") <= F.col("missing"), 1).otherwise(0))
        .select("label", "n", "train", (n - F.col("train")).alias("test"))
    )


def stratified_split(labelled: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exact class sizes, the rows chosen by a seeded hash of the key.

    Within a class the rows with the lowest hashes are held out, equal hashes in the order of the key, and rows that repeat a key
    stay together. Only the last held-out row of each class is looked up, so a class of any size never meets in one task.
    """
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), 1, 15)
    drawn = labelled.withColumn("draw", F.conv(digits, 16, 10).cast("long"))
    keys = durable(drawn.select("label", "draw", key), "draws")
    # one row per class
    sizes = {str(r["label"]): r for r in held_out_sizes(keys).collect() if r["test"]}
    targets = [Target(name, F.when(F.col("label") == r["label"], F.col("draw")), lambda n, last=r["test"]: (last,)) for name, r in sizes.items()]
    found = {name: hit for name, (hit,) in values_at_ranks(keys, targets).items()}
    # draws that rows inside and rows outside share
    shared = {name: sizes[name]["test"] - hit.before for name, hit in found.items() if hit.before + hit.equal > sizes[name]["test"]}
    lasts = keys_at_places(keys, key, {name: ((F.col("label") == sizes[name]["label"]) & (F.col("draw") == found[name].value), place) for name, place in shared.items()})
    is_test = F.lit(False)
    for name, hit in found.items():
        equal = F.col(key) <= F.lit(lasts[name]) if name in lasts else F.lit(True)
        within = (F.col("draw") < hit.value) | ((F.col("draw") == hit.value) & equal)
        is_test = F.when(F.col("label") == sizes[name]["label"], within).otherwise(is_test)
    return drawn.withColumn("is_test", is_test).drop("draw")
