"""Changes to the record table as joins: ingest, delete, trash, restore, retention, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import tokens as K

IDENTITY = ["session", "layer", "compaction_id", "fp"]


def unseen_records(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose fingerprint the session does not hold yet; blank fingerprints never enter."""
    known = stored.select("session", "fp").distinct()
    return fresh.where("fp is not null and fp <> ''").join(known, ["session", "fp"], "left_anti")


def unseen_compactions(events: DataFrame, stored: DataFrame) -> DataFrame:
    """First event of every compaction that has no records yet."""
    first = (
        events.where("compaction_id is not null and compaction_id <> ''")
        .groupBy("session", "compaction_id")
        .agg(F.min("seq").alias("seq"))
    )
    known = stored.select("session", "compaction_id").distinct()
    return first.join(known, ["session", "compaction_id"], "left_anti")


def split_deleted(records: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, victims) for the chosen ``session, fp`` pairs."""
    keys = chosen.select("session", "fp").distinct()
    return (
        records.join(keys, ["session", "fp"], "left_anti"),
        records.join(keys, ["session", "fp"], "left_semi"),
    )


def may_delete_session(activity: Column, now: Column, protect_days: int) -> Column:
    """Whole-session deletion waits until ``protect_days`` after the last activity."""
    if protect_days <= 0:
        return F.lit(True)
    return activity + F.make_interval(days=F.lit(protect_days)) <= now


def restorable(trash: DataFrame, stored: DataFrame) -> DataFrame:
    """Trash rows to bring back: absent from the store, one per identity, lowest ``ord`` first."""
    absent = trash.join(stored.select(*IDENTITY).distinct(), IDENTITY, "left_anti")
    keep = absent.groupBy(*IDENTITY).agg(F.min("ord").alias("ord"))
    return absent.join(keep, [*IDENTITY, "ord"], "left_semi")


def restore_counts(trash: DataFrame, stored: DataFrame) -> DataFrame:
    """``trash_id, restored, skipped`` when each trash entry is restored whole on its own."""
    per_entry = trash.groupBy("trash_id", *IDENTITY).agg(F.count("*").alias("_n"))
    known = stored.select(*IDENTITY).distinct().withColumn("_known", F.lit(True))
    marked = per_entry.join(known, IDENTITY, "left")
    is_new = F.col("_known").isNull()
    return marked.groupBy("trash_id").agg(
        F.count_if(is_new).alias("restored"),
        F.sum(F.col("_n") - F.when(is_new, 1).otherwise(0)).alias("skipped"),
    )


def list_trash(trash: DataFrame) -> DataFrame:
    """One row per trash entry, with block count and bytes; order by deleted_at descending."""
    return trash.groupBy("trash_id").agg(
        F.max("session").alias("session"),
        F.max("deleted_at").alias("deleted_at"),
        F.count("*").alias("blocks"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )


def expired_entries(entries: DataFrame, now: Column, days: int) -> DataFrame:
    return entries.where(F.col("deleted_at") < now - F.make_interval(days=F.lit(max(1, days))))


def orphaned_sessions(expired: DataFrame, remaining: DataFrame) -> DataFrame:
    """Sessions whose last trash entry expired; their excerpts can go."""
    return (
        expired.where("session <> ''").select("session").distinct()
        .join(remaining.select("session").distinct(), "session", "left_anti")
    )


def patch_keywords(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace keywords (at most 12) where ``updates`` has the ``session, fp``."""
    new = updates.select("session", "fp", F.slice("keywords", 1, 12).alias("_new"))
    return (
        records.join(new, ["session", "fp"], "left")
        .withColumn("patched", F.col("_new").isNotNull())
        .withColumn("keywords", F.coalesce("_new", "keywords"))
        .drop("_new")
    )


def tail(log: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of an append log, oldest first (a bounded top-k on both sorts)."""
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def label_pairs(rows: DataFrame, query_chars: int | None = None, title_chars: int | None = None) -> DataFrame:
    """Normalised human verdicts: hit or none, scores to four digits; texts are whole unless a length is given."""

    def text(name: str, chars: int | None) -> Column:
        return F.col(name) if chars is None else F.substring(name, 1, chars).alias(name)

    return rows.select(
        "at", "session",
        text("query", query_chars), "fp",
        F.when(F.col("verdict") == "hit", "hit").otherwise("none").alias("verdict"),
        K.round_half_up(F.col("score"), 4).alias("score"),
        text("title", title_chars),
    )


def usage_by_day(calls: DataFrame) -> DataFrame:
    """Calls and estimated tokens per day; negative or missing counts do not add."""

    def safe(name: str) -> Column:
        return F.sum(F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)))

    return calls.groupBy(F.to_date("at").alias("date")).agg(
        F.count("*").alias("calls"), safe("tokens_in").alias("tokens_in"),
        safe("tokens_out").alias("tokens_out"),
    )
