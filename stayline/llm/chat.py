"""Dialogues rendered once from each participant's side.

For every participant the dialogue is written with that speaker as the assistant and the others as named users;
only the speaker's own words are training targets. A dialogue of usual length is one row for each participant. A longer one goes on
in further rows, so that no row and no group grows with the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.storage import numbered, stored

#: Turns in one part, and messages with one turn number from which they are split further.
PART_TURNS = 64
#: Messages of one turn and role are ordered by so many characters of their text, then by its hash.
HEAD_CHARS = 64
#: Up to this many crowded turns or long dialogues (a few numbers and an opening each) are sent to every task.
SENT_PARTS = 10_000
SYSTEM, UNKNOWN = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"
KEY = ("conv_id", "part", "at_turn", "piece")
ORDER = ("turn", "role", "head", "hash")


def _messages(conversations: DataFrame) -> DataFrame:
    """Messages with a part number and what orders them; a missing text is empty."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    return conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.substring(text, 1, HEAD_CHARS).alias("head"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
        F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part"),
    )


def _sent(df: DataFrame) -> DataFrame:
    """A stored table of few rows goes to every task; a longer one is joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= SENT_PARTS else df


def _same(left: tuple[str, ...], right: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _with_pieces(messages: DataFrame) -> DataFrame:
    """Messages with at_turn and piece, null and 0 except in crowded parts.

    Where one turn number has more messages than a part should hold, each turn of its part stands alone, in pieces of ``PART_TURNS``
    messages in order. Repeated messages are rows like others, and are dealt to pieces as such.
    """
    per_turn = messages.groupBy("conv_id", "part", "turn").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(
        per_turn.groupBy("conv_id", "part").agg(F.max("n").alias("n")).where(F.col("n") > PART_TURNS)
        .select(F.col("conv_id").alias("c"), F.col("part").alias("p")),
        "crowded",
    )
    usual = {"at_turn": F.lit(None).cast("long"), "piece": F.lit(0).cast("long")}
    if not crowded.count():
        return messages.withColumns(usual)
    here = _same(("conv_id", "part"), ("c", "p"))
    rows, _ = numbered(messages.join(_sent(crowded), here, "left_semi"), *[F.col(c).asc_nulls_first() for c in ("conv_id", "part", *ORDER)], name="at")
    starts = stored(
        rows.groupBy("conv_id", "part", "turn").agg(F.min("at").alias("start"))
        .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("turn").alias("t"), "start"),
        "starts",
    )
    placed = rows.join(_sent(starts), _same(("conv_id", "part", "turn"), ("c", "p", "t")))
    pieces = placed.withColumns({"at_turn": F.col("turn"), "piece": F.expr(f"(at - start) DIV {PART_TURNS}")})
    rest = messages.join(_sent(crowded), here, "left_anti").withColumns(usual)
    return rest.unionByName(pieces.select(*rest.columns))


def _heading(role: Column, speaker: Column | None = None) -> Column:
    """The line above a message. A role cannot end that line or forge a marker."""
    name = F.replace(F.regexp_replace(F.coalesce(role, F.lit(UNKNOWN)), "[\\x00-\\x1f\\x7f]", " "), F.lit("<|"), F.lit("< |"))
    other = F.when(role == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    return other if speaker is None else F.when(role.eqNullSafe(speaker), F.lit(f"{START}assistant\n")).otherwise(other)


def _rendered(speaker: Column, message: Column) -> Column:
    head = _heading(message["role"], speaker)
    return F.struct(
        F.char_length(head).alias("head"),
        F.concat(head, message["text"], F.lit(END)).alias("text"),
        message["role"].eqNullSafe(speaker).alias("target"),
    )


def _spans(segments: Column, before: Column) -> Column:
    """Characters [start, end) of the speaker's messages, the end mark included and the heading left out."""
    kind = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(before.cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def add(state: Column, segment: Column) -> Column:
        end = state["at"] + F.char_length(segment["text"])
        span = F.struct((state["at"] + segment["head"]).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(segment["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(segments, start, add, lambda state: state["spans"])


def _openings(messages: DataFrame, parts: DataFrame) -> DataFrame | None:
    """(c, first, opening) of dialogues in several rows: the key of the first row, and the first system message of the first turn
    as it is rendered, null where there is none."""
    place = F.struct("part", "at_turn", "piece")
    long = parts.groupBy("conv_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    long = stored(long.select(F.col("conv_id").alias("c"), "first"), "long-dialogues")
    if not long.count():
        return None
    least = F.struct("turn", "head", "hash", "text")
    said = messages.join(_sent(long.select("c")), _same(("conv_id",), ("c",)), "left_semi").groupBy("conv_id").agg(
        F.min(F.struct("turn")).alias("start"), F.min(F.when(F.col("role") == SYSTEM, least)).alias("opening")
    )
    opening = F.concat(_heading(F.lit(SYSTEM)), F.col("opening.text"), F.lit(END))
    at_start = F.col("opening").isNotNull() & F.col("opening.turn").eqNullSafe(F.col("start.turn"))
    texts = said.select("conv_id", F.when(at_start, opening).alias("opening"))
    return stored(long.join(texts, _same(("conv_id",), ("c",))).select("c", "first", "opening"), "openings")


def rotate(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, participant and part of ``PART_TURNS`` turn numbers.

    Columns: conv_id, perspective (the participant), part, at_turn, piece, n_messages, opening_chars, text, targets (character spans
    of the participant's own messages, as start and end). Rows in the order of part, at_turn, piece make up the dialogue; at_turn
    and piece are null and 0 unless more than ``PART_TURNS`` messages share a turn number. Every row but the dialogue's first opens with the
    first system message of its first turn, if there is one: the first opening_chars characters repeat it, and n_messages does not count it.

    Participants are the roles of the conversation other than system, a missing role being one of its own, shown as "unknown"; system messages
    stay as they are for everyone, and a conversation of system messages alone gives no row. Messages are in the order of turn, role (null first in
    both), the first ``HEAD_CHARS`` characters of the text and its hash, at any size; every row is a message, repeated or not. Markers inside
    a text or a role are broken up by a blank, and control characters of a role are blanks. A null text is empty, a null conv_id a conversation
    of its own. Other columns are not read. No messages give no rows.
    """
    messages = _messages(conversations)
    dealt = _with_pieces(messages)
    speakers = messages.where(~F.col("role").eqNullSafe(SYSTEM)).select("conv_id", "role").distinct()
    parts = dealt.select(*KEY).distinct()
    headings = parts.join(speakers.select(F.col("conv_id").alias("c"), F.struct("role").alias("speaker")), _same(("conv_id",), ("c",))).select(*KEY, "speaker")
    said = dealt.select(*KEY, F.struct(*ORDER, "text").alias("message"), F.lit(None).cast(headings.schema["speaker"].dataType).alias("speaker"))
    asked = headings.select(*KEY, F.lit(None).cast(said.schema["message"].dataType).alias("message"), "speaker")
    # one shuffle of the texts; a group has PART_TURNS turns of as many messages at most
    together = said.unionByName(asked).groupBy(*KEY).agg(
        F.sort_array(F.collect_list("message")).alias("messages"), F.collect_set("speaker").alias("speakers")
    )
    rows = together.select(*KEY, "messages", F.explode("speakers.role").alias("perspective"))
    openings = _openings(messages, parts)
    if openings is None:
        opened = rows.withColumn("opening", F.lit(""))
    else:
        later = F.col("first") != F.struct("part", "at_turn", "piece")
        opened = rows.join(_sent(openings), _same(("conv_id",), ("c",)), "left").withColumn("opening", F.coalesce(F.when(later, F.col("opening")), F.lit("")))
    segments = opened.withColumn("segments", F.transform("messages", lambda m: _rendered(F.col("perspective"), m)))
    return segments.select(
        "conv_id", "perspective", "part", "at_turn", "piece",
        F.size("messages").cast("long").alias("n_messages"),
        F.char_length("opening").cast("long").alias("opening_chars"),
        F.concat("opening", F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("text"),
        _spans(F.col("segments"), F.char_length("opening")).alias("targets"),
    )


def spans_text(targets: str | Column = "targets") -> Column:
    """Spans as text, start-end with commas between."""
    return F.array_join(F.transform(targets, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
