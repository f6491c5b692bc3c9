"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule. Policies are versioned masks over those bits, so a new policy, or leaving one rule out, never
reads a text again. Built-in SQL functions only; no shuffle, one row in, one row out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bit positions of the rules; a position is never reused for another rule.
FEW_WORDS, REPEATED_WORDS, SYMBOLS, DUPLICATE_LINES, WORD_LENGTH = range(5)
RULES = {
    FEW_WORDS: "few_words",
    REPEATED_WORDS: "repeated_words",
    SYMBOLS: "symbols",
    DUPLICATE_LINES: "duplicate_lines",
    WORD_LENGTH: "word_length",
}

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask_of(*rules: int) -> int:
    return sum(1 << rule for rule in rules)


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the rules in ``mask`` failed."""

    version: str
    mask: int


BASE = Policy("base-1", mask_of(FEW_WORDS, REPEATED_WORDS))
STANDARD = Policy("standard-1", mask_of(*RULES))
POLICIES = (BASE, STANDARD)


def _repeat_words(words: str) -> str:
    """SQL for the number of words inside 3-word windows that occur twice or more in ``words``.

    Windows are hashed first. Only where two hashes agree are they written out and sorted, equal ones
    next to each other, and the stretches that they cover added up; so a hash collision costs time, never a
    wrong count. ``transform(array(x), v -> ...)[0]`` gives a computed array a name inside an expression.
    """
    window = "{w}[i], {w}[i + 1], {w}[i + 2]"
    hashes = f"transform(sequence(0, size(w) - 3), i -> xxhash64({window.format(w='w')}))"
    ordered = (
        "sort_array(transform(sequence(0, size(w) - 3), i -> struct("
        f"xxhash64({window.format(w='w')}) AS h, concat_ws(' ', {window.format(w='w')}) AS t, i AS i)))"
    )
    same = "(s[{k}].h = x.h AND s[{k}].t = x.t)"
    repeated = (
        f"filter(s, (x, k) -> (k > 0 AND {same.format(k='greatest(k - 1, 0)')})"
        f" OR (k < size(s) - 1 AND {same.format(k='least(k + 1, size(s) - 1)')}))"
    )
    covered = (
        f"aggregate(sort_array(transform({repeated}, x -> x.i)), struct(0L AS n, 0 AS upto),"
        " (a, i) -> struct(a.n + (i + 3 - greatest(i, a.upto)) AS n, i + 3 AS upto), a -> a.n)"
    )
    return (
        f"transform(array({words}), w -> if(size(w) < 3, 0L, if("
        f"transform(array({hashes}), h -> size(array_distinct(h)) = size(h))[0], 0L, "
        f"transform(array({ordered}), s -> {covered})[0])))[0]"
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASUREMENTS`` (long) in front of the failure bits.

    A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage
    return. A null text counts as empty: every measurement is 0. Columns of ``docs`` with the name of a
    measurement are replaced.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, dense, lines = (_free(name, docs.columns) for name in ("_words", "_dense", "_lines"))
    return (
        docs.withColumn(words, F.array_remove(F.split(value, r"[\x20\x09-\x0D]+"), ""))
        .withColumn(dense, F.array_join(words, ""))
        .withColumn(lines, F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumns({
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(dense).cast("long"),
            "n_symbols": (F.size(F.split(dense, "[#*$%&|<>]")) - 1).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.expr(_repeat_words(words)),
        })
        .drop(words, dense, lines)
    )


def _free(name: str, taken: list[str]) -> str:
    """``name`` with as many more underscores in front as it takes to differ from all columns."""
    while name in taken:
        name = f"_{name}"
    return name


def rule_failures() -> dict[int, Column]:
    """For each rule the condition that it fails, over the measurements and in whole numbers.

    Fewer than 50 words; over half the words in repeated windows; more than one symbol in ten words; over
    half the lines repeated; fewer than 3 or more than 12 characters a word on average.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        FEW_WORDS: n < 50,
        REPEATED_WORDS: 100 * F.col("n_repeat_words") > 50 * n,
        SYMBOLS: 10 * F.col("n_symbols") > n,
        DUPLICATE_LINES: 2 * F.col("n_dup_lines") > F.col("n_lines"),
        WORD_LENGTH: (chars < 3 * n) | (chars > 12 * n),
    }


def failure_bits() -> Column:
    bits = F.lit(0)
    for rule, failed in rule_failures().items():
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << rule)).otherwise(F.lit(0)))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failed_rules``, the bits of all rules that failed (int)."""
    return measure(docs, text).withColumn("failed_rules", failure_bits())


def passes(policy: Policy) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(policy.mask)) == 0


def keep(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their own columns."""
    names = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("_text"))
    return ledger(packed, "_text").where(passes(policy)).select(*names)


def ablation(ledgers: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule of each policy removes.

    Columns policy, rule, failed (documents that fail the rule), only_this (documents that the policy would
    keep without it), removed (by the whole policy), total. Documents are first counted by their bits, at
    most two to the number of rules; everything else is read off those counts.
    """
    counts = ledgers.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(
        F.array(*[
            F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).alias("mask"), F.lit(name).alias("rule"), F.lit(1 << bit).alias("bit"))
            for p in policies
            for bit, name in RULES.items()
            if p.mask >> bit & 1
        ])
    ).alias("case")
    hit = F.col("failed_rules").bitwiseAND(F.col("mask"))
    return (
        counts.select("failed_rules", "n", cases)
        .select("failed_rules", "n", "case.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("removed"),
            F.sum("n").alias("total"),
        )
    )
