"""Reading old text back: blocks of the store, and the log's turns where the store has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import tokens as K
from palimpsest.operators.diagnose import history
from palimpsest.operators.index import BlockIndex
from palimpsest.operators.ordered import top_per_key
from palimpsest.operators.search import search
from palimpsest.session import offered

SOURCES = ("auto", "store", "log")
COLUMNS = ["query_id", "session", "place", "text"]


def _latest(asked: DataFrame, rows: DataFrame, order: str, text: Column, limit: int) -> DataFrame:
    """The last ``limit`` rows of each question's session, oldest first."""
    wanted = offered(asked.select("session").distinct())
    own = rows.select("session", order, text.alias("text")).join(wanted, "session", "left_semi")
    last = top_per_key(own, ["session"], [F.desc(order)], limit, "_back")
    # places follow the rows that there are; a session has at most ``limit`` of them
    count = last.groupBy("session").agg(F.max("_back").alias("_n"))
    placed = last.join(count, "session").withColumn("place", F.col("_n") - F.col("_back") + 1)
    return asked.select("query_id", "session").join(placed, "session").select(*COLUMNS)


def _from_store(index: BlockIndex, records: DataFrame, named: DataFrame, blank: DataFrame, limit: int) -> DataFrame:
    hits = search(index, named, limit=limit, layers=["raw"]).select("query_id", "session", "ord", F.col("rank").alias("place"))
    raw = records.where("layer = 'raw'")
    found = offered(hits).join(raw.select("session", "ord", "text"), ["session", "ord"]).select(*COLUMNS)
    return found.unionByName(_latest(blank, raw, "ord", F.col("text"), limit))


def _from_log(turns: DataFrame, named: DataFrame, blank: DataFrame, limit: int) -> DataFrame:
    shown = F.concat(F.lit("问："), "user", F.when(F.col("assistant") == "", F.lit("")).otherwise(F.concat(F.lit("\n答："), "assistant")))
    own = K.token_set(F.concat_ws("\n", "user", "assistant"))
    wanted = named.select("query_id", "session", K.token_set(F.col("text")).alias("_wanted"))
    scored = (
        turns.select("session", "turn_no", own.alias("_own"), shown.alias("text")).join(wanted, "session")
        .withColumn("score", F.round(K.jaccard(F.col("_wanted"), F.col("_own")), 9)).where("score > 0")
    )
    best = top_per_key(scored, ["query_id", "session"], [F.desc("score"), F.asc("turn_no")], limit, "place")
    return best.select(*COLUMNS).unionByName(_latest(blank, turns, "turn_no", shown, limit))


def history_read(
    index: BlockIndex, records: DataFrame, turns: DataFrame, questions: DataFrame, *, limit: int = 5,
    max_chars: int = 12_000, source: str = "auto",
) -> DataFrame:
    """``query_id, session, place, source, text``: old text for each question, within one budget of characters.

    ``questions``: query_id, session, text. A blank text asks for the latest blocks. ``index`` covers the raw
    ``records``; ``turns`` are those of ``conversation_turns``. The store answers first; only the questions for
    which it has nothing go on to the log's turns (``source`` picks one of both). The budget runs over a
    question's pieces whichever source they come from; the one that crosses it is cut, the rest left out.
    """
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    asked = questions.withColumn("text", K.trim_ws(F.coalesce("text", F.lit("")))).select("query_id", "session", "text")
    rows = None
    if source != "log":
        rows = _from_store(index, records, asked.where("text <> ''"), asked.where("text = ''"), limit).withColumn("source", F.lit("store"))
    if source != "store":
        left = asked if rows is None else asked.join(rows.select("query_id", "session").distinct(), ["query_id", "session"], "left_anti")
        log = _from_log(turns, left.where("text <> ''"), left.where("text = ''"), limit).withColumn("source", F.lit("log"))
        rows = log if rows is None else rows.unionByName(log)
    keyed = rows.withColumn("key", F.struct("query_id", "session"))
    return history(keyed, limit, max_chars).select("query_id", "session", F.col("place").cast("bigint").alias("place"), "source", "text")
