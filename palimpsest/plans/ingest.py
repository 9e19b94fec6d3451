"""From session events and compactions to stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import tokens as K
from palimpsest.functions.chunks import summary_sections
from palimpsest.functions.sanitize import sanitize
from palimpsest.operators.packing import raw_blocks
from palimpsest.operators.records import RECORD_COLUMNS, finish_records
from palimpsest.operators.tools import tool_blocks
from palimpsest.operators.turns import conversation_turns, in_ranges
from palimpsest.session import settle
from palimpsest.settings import Settings

_MARK = "\u0001"
#: Where a block belongs: session, seq of its compaction, kind (summary, raw, tool), place.
ORDER = ["session", "_seq", "_kind", "_place"]


def _facts(compactions: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return compactions.select(
        F.concat_ws(_MARK, "session", "compaction_id").alias("_key"), "session", "compaction_id",
        at.alias("at"), F.col("seq").alias("_seq"), "turn", "seq_start", "seq_end", "shadowed_tokens",
    )


def summary_blocks(compactions: DataFrame) -> DataFrame:
    """Sections of each compaction's summary text."""
    text = sanitize(F.regexp_replace("text", "</?compacted-summary>", ""))
    return compactions.select(
        F.concat_ws(_MARK, "session", "compaction_id").alias("_key"),
        F.posexplode(summary_sections(text)),
    ).select("_key", F.col("pos").cast("bigint").alias("_place"), F.col("col").alias("text"))


def compaction_records(
    events: DataFrame, compactions: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Records of every compaction: summary sections, raw turns and tool results.

    ``events``: session, seq, type, kind, text, call_id, name, args, is_error.
    ``compactions``: session, compaction_id, seq, time_ms, turn, seq_start, seq_end,
    shadowed_tokens, text. Raw and tool blocks come from the compaction's own seq range.
    """
    inside = None
    if settings.ingestRawText:
        inside = in_ranges(events, compactions.select("session", "compaction_id", "seq_start", "seq_end"))
    return finished(ingest_rows(inside, compactions, settings)).select(*RECORD_COLUMNS)


def ingest_rows(
    inside: DataFrame | None, compactions: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """Blocks of every compaction in any order; ``ORDER`` says where each belongs.

    ``inside``: the events of each compaction's range with its session and compaction_id.
    """
    facts = _facts(compactions)
    none = F.lit(None).cast("string")
    parts = []
    if settings.ingestSummary:
        parts.append(summary_blocks(compactions).withColumns({
            "layer": F.lit("summary"), "_from": F.col("text"), "_kind": F.lit(0),
            "src": none, "tool": none, "_own_seq": F.lit(None).cast("bigint"), "_named": none,
        }))
    if settings.ingestRawText:
        inside = settle(inside.withColumn("_key", F.concat_ws(_MARK, "session", "compaction_id")))
        spoken = inside.drop("session").withColumnRenamed("_key", "session")
        raw = raw_blocks(
            conversation_turns(spoken), "session", settings.maxRawCharsPerCompaction
        )
        named = F.when(F.col("question") != "", F.col("question")).otherwise(
            F.regexp_replace("text", "^问：", "")
        )
        parts.append(raw.select(
            F.col("session").alias("_key"), F.col("place").alias("_place"), "text",
            F.lit("raw").alias("layer"), named.alias("_from"), F.lit(1).alias("_kind"),
            none.alias("src"), none.alias("tool"), F.lit(None).cast("bigint").alias("_own_seq"),
            none.alias("_named"),
        ))
        if settings.includeToolResults:
            results = spoken.where("type = 'tool/result'")
            calls = spoken.where("type = 'tool/call'").select("session", "call_id", "seq", "name", "args")
            tools = tool_blocks(
                results.select("session", F.col("session").alias("_key"), "seq", "call_id", "is_error", "text"),
                calls, "_key", names=settings.toolResultNames,
                max_chars=settings.toolResultMaxChars, budget=settings.toolResultBudgetChars,
            )
            parts.append(tools.select(
                "_key", F.col("seq").alias("_place"), "text", F.lit("raw").alias("layer"),
                F.concat_ws("\n", "target", "name", "text").alias("_from"), F.lit(2).alias("_kind"),
                F.lit("tool").alias("src"), F.col("name").alias("tool"),
                F.col("seq").alias("_own_seq"), F.col("title").alias("_named"),
            ))
    if not parts:
        raise ValueError("both ingestSummary and ingestRawText are off")
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    rows = rows.join(facts, "_key").withColumns({
        "seq_start": F.coalesce("_own_seq", "seq_start"), "seq_end": F.coalesce("_own_seq", "seq_end"),
    }).where(~K.is_blank(F.col("text")))
    return rows


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with an ``ord`` that follows ``ORDER``, settled because later steps join on it."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(
        rows.repartitionByRange(width, *ORDER).sortWithinPartitions(*ORDER)
        .withColumn("ord", F.monotonically_increasing_id())
    )


def finished(rows: DataFrame) -> DataFrame:
    """Numbered records with title, keywords and fingerprint; the order columns stay."""
    return finish_records(numbered(rows), title_from="_from").withColumn("title", F.coalesce("_named", "title"))
