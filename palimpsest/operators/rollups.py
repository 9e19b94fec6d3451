"""Overviews per session and per workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.tokens import ws_class
from palimpsest.operators.ordered import row_number


def session_rollup(
    records: DataFrame, now: Column, protect_days: int = 7, files: DataFrame | None = None
) -> DataFrame:
    """Blocks per layer, compactions, activity and remaining protection of each session.

    ``files``: session, mtime — newest log or store file; activity is the latest of all times.
    """
    day_ms = 86_400_000
    title = F.max_by("title", F.when((F.col("layer") == "summary") & (F.col("title") != ""), F.col("ord")))
    out = records.groupBy("session").agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("layer") != "raw").alias("summary_blocks"),
        F.count_if(F.col("layer") == "raw").alias("raw_blocks"),
        F.count_distinct(F.nullif("compaction_id", F.lit(""))).alias("compactions"),
        F.max(F.unix_millis(F.try_to_timestamp("at"))).alias("updated_ms"),
        F.coalesce(title, F.max_by("title", "ord")).alias("title"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )
    out = out.withColumn("activity_ms", F.coalesce("updated_ms", F.lit(0)))
    if files is not None:
        newest = files.groupBy("session").agg(F.max(F.unix_millis("mtime")).alias("_file_ms"))
        out = out.join(newest, "session", "left").withColumn(
            "activity_ms", F.greatest("activity_ms", F.coalesce("_file_ms", F.lit(0)))
        ).drop("_file_ms")
    left = F.col("activity_ms") + protect_days * day_ms - F.unix_millis(now)
    safe = (left > 0) & F.lit(protect_days > 0)
    return out.withColumn("protected", safe).withColumn(
        "protect_days_left", F.when(safe, F.ceil(left / day_ms)).otherwise(0).cast("bigint")
    )


def workspace_rollup(sessions: DataFrame, workspace: str = "workspace") -> DataFrame:
    return sessions.groupBy(workspace).agg(
        F.count("*").alias("sessions"), F.sum("blocks").alias("blocks"),
        F.sum("bytes").alias("bytes"), F.max("activity_ms").alias("activity_ms"),
    )


def score_bands(scored: DataFrame, score: str, width: float = 0.1) -> DataFrame:
    """How many questions have their best score in each band of ``width``."""
    band = F.floor(F.col(score) / width + 1e-9).cast("bigint")
    return scored.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")
    )


def verdict_counts(pairs: DataFrame, key: str) -> DataFrame:
    """Hits and misses of judged questions per key, with their distinct sessions."""
    return pairs.groupBy(key).agg(
        F.count_if(F.col("verdict") == "hit").alias("hits"),
        F.count_if(F.col("verdict") != "hit").alias("misses"),
        F.count_distinct("session").alias("sessions"),
    )


def volume_by_type(rows: DataFrame, kind: str, text: str, batch: int = 8) -> DataFrame:
    """Rows, characters and batches of ``batch`` rows per kind of row."""
    return rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.sum(F.length(text)).cast("bigint").alias("chars"),
        F.ceil(F.count("*") / batch).cast("bigint").alias("batches"),
    )


def expansion_savings(
    records: DataFrame, block_chars: int = 600, batch_before: int = 5, batch_after: int = 5, shortest: int = 120
) -> DataFrame:
    """What keyword expansion would send before and after tool blocks are left out, with totals.

    ``records``: session, compaction_id, ord, text, src. One row per compaction, per session and for all:
    blocks, and for both ways the targets, calls, characters and tokens sent; ``saved`` is the share of tokens
    spared, ``share`` the row's part of all tokens sent before. Null where nothing was sent. Blocks of
    ``shortest`` characters or more are targets; a call holds up to a batch of blocks, numbered from 0.
    """
    keys = ["session", "compaction_id"]
    rows = records.select(*keys, "ord", F.coalesce("text", F.lit("")).alias("text"), "src")

    def calls(targets: DataFrame, batch: int, way: str) -> DataFrame:
        numbered = row_number(targets, keys, "ord", "_n").withColumn("_n", F.col("_n") - 1)
        piece = F.concat(F.lit("["), (F.col("_n") % batch).cast("string"), F.lit("] "), F.substring("text", 1, block_chars))
        ink = F.regexp_replace("_piece", ws_class("[WS]+"), "")
        other = F.length(F.regexp_replace(ink, f"[{V.CJK}]+", ""))
        sized = numbered.withColumn("_piece", piece).withColumns({"_ink": F.length(ink), "_other": other})
        tokens = F.ceil((F.sum("_ink") - F.sum("_other")) * F.lit(0.85) + F.sum("_other") / F.lit(4.0)).cast("bigint")
        return sized.groupBy(*keys, F.floor(F.col("_n") / batch).alias("_call")).agg(
            F.count("*").alias("targets"), (F.sum(F.length("_piece")) + 2 * (F.count("*") - 1)).alias("chars"), tokens.alias("tokens"),
        ).withColumns({"way": F.lit(way), "blocks": F.lit(0).cast("bigint")})

    long = rows.where(F.length("text") >= shortest)
    sent = calls(long, batch_before, "before").unionByName(calls(long.where("src is null or src <> 'tool'"), batch_after, "after"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("blocks")).withColumns(
        {"targets": F.lit(0), "chars": F.lit(0), "tokens": F.lit(0), "way": F.lit("none")}
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("way") == way, value)), F.lit(0)).cast("bigint").alias(f"{name}_{way}")
        for way in ("before", "after")
        for name, value in (("targets", F.col("targets")), ("calls", F.lit(1)), ("chars", F.col("chars")), ("tokens", F.col("tokens")))
    ]
    rolled = sent.drop("_call").unionByName(counted).rollup(*keys).agg(
        F.grouping_id().alias("_level"), F.sum("blocks").alias("blocks"), *sums
    )
    level = F.when(F.col("_level") == 0, "compaction").when(F.col("_level") == 1, "session").otherwise("total")
    whole = F.broadcast(rolled.where("_level = 3").select(F.lit(1).alias("_one"), F.col("tokens_before").alias("_whole")))  # one row
    return (
        rolled.withColumns({"level": level, "_one": F.lit(1)}).join(whole, "_one")
        .withColumns({
            "saved": 1 - F.col("tokens_after") / F.nullif("tokens_before", F.lit(0)),
            "share": F.col("tokens_before") / F.nullif("_whole", F.lit(0)),
        }).drop("_one", "_level", "_whole")
    )
