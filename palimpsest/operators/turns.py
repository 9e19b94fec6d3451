"""Folding session events into turns, and binding messages to the questions behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.functions.sanitize import strip_markers
from palimpsest.operators.ordered import last_before, running_sum, top_per_key

RANGE_SLICE = 4096


def is_user(col: str = "type") -> Column:
    return F.col(col) == "user/message"


def is_assistant(col: str = "type") -> Column:
    return F.col(col) == "assistant/message"


def conversation_turns(events: DataFrame) -> DataFrame:
    """``session, turn_no, seq, user, assistant``: each kept user message opens a turn.

    ``events``: session, seq, type, kind, text. A user message equal to the row before it is a
    retry and is skipped; assistant texts are joined by newlines; an answer without a question
    is ignored.
    """
    spoken = (
        events.where((is_user() & (F.col("kind") == "user")) | is_assistant())
        .withColumn("text", strip_markers(F.col("text")))
        .where(~K.is_blank(F.col("text")))
        .select("session", "seq", "type", "text")
    )
    previous = F.struct("type", F.when(is_user(), F.col("text")).alias("user"))
    seen = last_before(spoken, ["session"], "seq", previous, "_prev")
    retry = is_user() & F.coalesce(
        (F.col("_prev.type") == "user/message") & (F.col("_prev.user") == F.col("text")),
        F.lit(False),
    )
    opened = running_sum(
        seen.where(~retry).drop("_prev"), ["session"], "seq", is_user().cast("bigint"), "turn_no"
    )
    answer = F.when(is_assistant(), F.struct("seq", "text"))
    return (
        opened.where("turn_no > 0")
        .groupBy("session", "turn_no")
        .agg(
            F.min("seq").alias("seq"),
            F.max(F.when(is_user(), F.col("text"))).alias("user"),
            F.array_sort(F.collect_list(answer)).alias("_answers"),
        )
        .select(
            "session", "turn_no", "seq", "user",
            F.array_join(F.transform("_answers", lambda a: a["text"]), "\n").alias("assistant"),
        )
    )


def human_questions(events: DataFrame) -> DataFrame:
    """User messages a person asked: not a notice, sent through a request, with clean text.

    Optional columns ``form`` and ``rpc_id`` tighten the test when the log carries them.
    """
    asked = is_user() & (F.col("kind") == "user")
    if "form" in events.columns:
        asked = asked & (F.coalesce("form", F.lit("")) != "notice")
    if "rpc_id" in events.columns:
        asked = asked & ~K.is_blank(F.coalesce("rpc_id", F.lit("")))
    cleaned = events.where(asked).withColumn("text", K.trim_ws(strip_markers(F.col("text"))))
    return cleaned.where((F.col("text") != "") & ~F.contains("text", F.lit(V.MARKER)))


def last_questions(events: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` questions per session: joined text, the latest one and its seq."""
    recent = top_per_key(human_questions(events), ["session"], [F.desc("seq")], max(1, n), "_rank")
    return recent.groupBy("session").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]
            ),
            "\n",
        ).alias("text"),
        F.max_by("text", "seq").alias("latest"),
        F.max("seq").alias("seq"),
    )


def message_questions(events: DataFrame) -> DataFrame:
    """For every assistant message, the question it answers (an as-of lookup).

    The question must come after the message's turn start when that is logged, else after the
    previous assistant message.
    """
    questions = human_questions(events).select(
        "session", "seq", F.lit("q").alias("mark"), F.col("text").alias("q_text")
    )
    messages = events.where(is_assistant()).select(
        "session", "seq", F.lit("a").alias("mark"), F.lit(None).cast("string").alias("q_text"),
        *(["turn"] if "turn" in events.columns else []),
    )
    merged = questions.unionByName(messages, allowMissingColumns=True)
    asked = F.when(F.col("mark") == "q", F.struct("seq", F.col("q_text").alias("text")))
    answered = F.when(F.col("mark") == "a", F.col("seq"))
    carried = last_before(merged, ["session"], "seq", asked, "_q")
    carried = last_before(carried, ["session"], "seq", answered, "_a").where("mark = 'a'")
    if "turn" in events.columns:
        starts = (
            events.where("type = 'turn/start' and turn is not null")
            .groupBy("session", "turn")
            .agg(F.min("seq").alias("_start"))
        )
        carried = carried.join(starts, ["session", "turn"], "left")
    else:
        carried = carried.withColumn("_start", F.lit(None).cast("bigint"))
    boundary = F.coalesce("_start", "_a", F.lit(0))
    ok = F.coalesce(F.col("_q.seq") > boundary, F.lit(False))
    return carried.select(
        "session", "seq",
        F.coalesce("_a", F.lit(0)).alias("previous_seq"),
        F.when(ok, F.col("_q.seq")).otherwise(F.lit(-1)).alias("question_seq"),
        F.when(ok, F.col("_q.text")).otherwise(F.lit("")).alias("question"),
        F.when(ok, F.lit("")).otherwise(F.lit("no-question")).alias("reason"),
    )


def in_ranges(events: DataFrame, ranges: DataFrame, width: int = RANGE_SLICE) -> DataFrame:
    """Events inside each valid ``[seq_start, seq_end]`` of their session, both ends included.

    Sessions are cut into slices of ``width`` sequence numbers and a range goes to the slices that it
    touches, so a busy session is dealt over many tasks and meets no range that lies elsewhere.
    """
    extent = events.groupBy("session").agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))
    low, high = F.greatest("seq_start", "_low"), F.least("seq_end", "_high")
    sliced = (
        ranges.where("seq_start is not null and seq_end is not null and seq_end >= seq_start")
        .join(extent, "session").where(low <= high)
        .withColumn("_slice", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
        .drop("_low", "_high")
    )
    inside = (F.col("seq") >= F.col("seq_start")) & (F.col("seq") <= F.col("seq_end"))
    return (
        events.withColumn("_slice", F.floor(F.col("seq") / width))
        .join(sliced, ["session", "_slice"]).where(inside).drop("_slice")
    )
