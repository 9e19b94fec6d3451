"""Chunking of whole documents, and the rate limiter over the activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog.chunk_sql import SPLIT_BLOCKS, SUMMARY_SECTIONS
from palimpsest.functions.chunks import split_blocks, summary_sections
from palimpsest.operators.ordered import row_number
from palimpsest.sources.tables import table
from palimpsest.streaming.state import rate_limited

registry = Registry()


def _headed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    headed = F.regexp_replace("text", r"\. ([A-F])", ".\n\n## $1")
    return docs.withColumn("text", headed)


@registry.add("split_blocks", SPLIT_BLOCKS)
def split_blocks_query(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", F.posexplode(split_blocks(F.col("text")))).select(
        "doc_id", "pos", F.col("col").alias("block")
    )


@registry.add("summary_sections", SUMMARY_SECTIONS)
def summary_sections_query(spark, sf_dir):
    return _headed(spark, sf_dir).select(
        "doc_id", F.posexplode(summary_sections(F.col("text")))
    ).select("doc_id", "pos", F.col("col").alias("block"))


_WINDOW = 6 * 3600 * 1000


@registry.add(
    "rate_limit",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS at_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
walk AS (
  SELECT key, n, at_ms, TRUE AS allowed, 0::BIGINT AS retry_after_ms, [at_ms] AS stamps FROM c WHERE n = 1
  UNION ALL
  SELECT key, n, at_ms, len(live) < 2, CASE WHEN len(live) < 2 THEN 0 ELSE greatest(0, live[1] + {_WINDOW} - at_ms) END,
    CASE WHEN len(live) < 2 THEN list_append(live, at_ms) ELSE live END
  FROM (SELECT c.key, c.n, c.at_ms, list_filter(w.stamps, lambda s: s > c.at_ms - {_WINDOW}) AS live
        FROM walk w JOIN c ON c.key = w.key AND c.n = w.n + 1))
SELECT key, n, at_ms, allowed, retry_after_ms FROM walk""",
)
def rate_limit(spark, sf_dir):
    """At most two events per user in six hours."""
    events = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    calls = row_number(events, ["user_id"], "event_id", "n").select(
        F.col("user_id").alias("key"), "n", ms.alias("at_ms")
    )
    return rate_limited(calls, _WINDOW, 2)
