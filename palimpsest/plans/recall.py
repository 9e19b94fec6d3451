"""From the newest questions of sessions to the recall block each one shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.operators.index import BlockIndex
from palimpsest.operators.recall import format_recall, fresh_hits
from palimpsest.operators.tiers import segmented
from palimpsest.operators.turns import last_questions
from palimpsest.settings import Settings


def attempts(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Texts to try per session: the latest question, and the joined ones if it is too short."""
    asked = last_questions(events, settings.observationTurns)
    own = F.size(K.token_set(F.col("latest")))
    latest = F.length("latest") >= 3
    joined = (F.col("text") != F.col("latest")) & (own < V.EVIDENCE_FLOOR)
    tries = F.filter(
        F.array(
            F.when(latest, F.struct(F.lit(0).alias("step"), F.col("latest").alias("text"))),
            F.when(joined | ~latest, F.struct(F.lit(1).alias("step"), F.col("text").alias("text"))),
        ),
        lambda t: t.isNotNull(),
    )
    return asked.select("session", "seq", F.explode(tries).alias("t")).select(
        "session", "seq", "t.step", "t.text"
    )


def cooled_down(asked: DataFrame, last_hits: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Drop sessions asking nearly what their last hit answered (cooldown is on or off)."""
    if settings.cooldownTurns <= 0:
        return asked
    seen = last_hits.select("session", K.token_set(F.col("text")).alias("_last"))
    near = K.jaccard(K.token_set(F.col("text")), F.col("_last")) >= V.COOLDOWN_SIMILARITY
    return asked.join(seen, "session", "left").where(
        F.col("_last").isNull() | ~near
    ).drop("_last")


def recall_blocks(
    index: BlockIndex, records: DataFrame, asked: DataFrame, *, settings: Settings = Settings(),
    injected: DataFrame | None = None, boost: DataFrame | None = None,
) -> DataFrame:
    """Recall text per session for ``asked`` (session, step, text); the first step that hits wins."""
    queries = asked.withColumn("query_id", F.col("step")).select("query_id", "session", "text")
    ranked = segmented(
        index, queries, min_score=settings.minScore, max_items=settings.maxItems,
        prefer_summary=settings.preferSummaryChunks, params=settings.time_params(),
    ).where("picked")
    winner = ranked.groupBy("session").agg(F.min("query_id").alias("query_id"))
    chosen = ranked.join(winner, ["session", "query_id"], "left_semi").join(
        records.select("session", "ord", "text"), ["session", "ord"]
    )
    fresh = fresh_hits(
        chosen, max_chars=settings.maxCharsPerItem, dedupe=settings.dedupe, injected=injected,
        boost=boost,
    )
    return format_recall(fresh, max_items=settings.maxItems, max_tokens=settings.maxTokensPerTurn)
