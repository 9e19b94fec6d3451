"""Raw session events to the frames that the plans take: one dispatcher for batch and stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.sanitize import text_of_blocks
from palimpsest.functions.tokens import is_blank
from palimpsest.plans.ingest import compaction_records
from palimpsest.settings import Settings

EVENT_COLUMNS = ["session", "seq", "type", "kind", "text", "call_id", "name", "args", "is_error"]
COMPACTION_COLUMNS = [
    "session", "compaction_id", "seq", "time_ms", "turn", "seq_start", "seq_end", "shadowed_tokens", "text",
]


def route_of(settings: Settings = Settings()) -> Column:
    """What an event sets off: ingest, recap, prune, question, turn; null for the rest.

    A compaction without an id, or with both layers switched off, is not ingested.
    """
    kind = F.col("type")
    stored = settings.ingestSummary or settings.ingestRawText
    return (
        F.when((kind == "compaction/summary") & ~is_blank(F.coalesce("compaction_id", F.lit(""))) & F.lit(stored), "ingest")
        .when(kind == "compaction/end", "recap")
        .when((kind == "compaction/prune") & F.lit(settings.includePrune), "prune")
        .when(kind.isin("agent/inbox/spliced", "user/message"), "question")
        .when(kind.isin("turn/start", "turn/end"), "turn")
    )


@dataclass(frozen=True)
class Routed:
    """Frames of one pass over raw events; each is a filter, so batch and stream behave alike.

    events: what turns and tool results are made of     compactions: to be ingested
    recaps, prunes: session, seq, time_ms (prunes with their range)
    turns: session, turn, seq, starts                   questions: session, seq, kind, rpc_id, text
    """

    events: DataFrame
    compactions: DataFrame
    recaps: DataFrame
    prunes: DataFrame
    turns: DataFrame
    questions: DataFrame


def dispatch(raw: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> Routed:
    """Deal raw events (``parse_events``) out to their routes. ``keep`` names columns carried along."""
    told = raw.withColumns({"route": route_of(settings), "text": text_of_blocks(F.col("blocks"))})

    def on(route: str) -> DataFrame:
        return told.where(F.col("route") == route)

    # a range ends before the compaction itself at the latest
    end = F.least("seq_end", F.coalesce("seq", "seq_end"))
    return Routed(
        events=told.where("seq is not null").select(*EVENT_COLUMNS, *keep),
        compactions=on("ingest").withColumn("seq_end", end).select(*COMPACTION_COLUMNS, *keep),
        recaps=on("recap").select("session", "seq", "time_ms", *keep),
        prunes=on("prune").select("session", "seq", "time_ms", "seq_start", "seq_end", "shadowed_tokens", *keep),
        turns=on("turn").select("session", "turn", "seq", (F.col("type") == "turn/start").alias("starts"), *keep),
        questions=on("question").select("session", "seq", "kind", "rpc_id", "text", *keep),
    )


def backfill(raw: DataFrame, known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Records of the compactions in ``raw`` that ``known`` (session, compaction_id) lacks."""
    routed = dispatch(raw, settings)
    unseen = routed.compactions.join(known.select("session", "compaction_id").distinct(), ["session", "compaction_id"], "left_anti")
    first = unseen.groupBy("session", "compaction_id").agg(F.min("seq").alias("seq"))
    once = unseen.join(first, ["session", "compaction_id", "seq"], "left_semi")
    return compaction_records(routed.events, once.dropDuplicates(["session", "compaction_id"]), settings)
