"""Store changes and overviews: ingest, trash, retention, patches, rollups, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import tokens as K
from palimpsest.operators import mutations as M
from palimpsest.operators.records import first_occurrences
from palimpsest.operators.rollups import session_rollup, workspace_rollup
from palimpsest.catalog.search_queries import stored_records
from palimpsest.sources.tables import document_blocks, table

registry = Registry()

_FP = "substr(sha1(layer || chr(0) || text), 1, 16)"
_STORE = f"""{S.BLOCKS}, b AS MATERIALIZED (SELECT *, {_FP} AS fp FROM blocks),
stored AS (SELECT * FROM b WHERE ord IN (SELECT doc_id FROM labels)), fresh AS (SELECT * FROM b)"""


def _blocks(spark, sf_dir):
    return document_blocks(spark, sf_dir).withColumn(
        "fp", K.fingerprint(F.col("layer"), F.col("text"))
    )


def _stored(spark, sf_dir):
    """Blocks a person has labelled count as already stored; all blocks arrive again as fresh."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"))
    return _blocks(spark, sf_dir).join(labelled, "ord", "left_semi")


def _fresh(spark, sf_dir):
    return _blocks(spark, sf_dir)


@registry.add(
    "fp_dedupe",
    f"WITH {_STORE} SELECT session, ord, fp FROM b QUALIFY row_number() OVER (PARTITION BY session, fp ORDER BY ord) = 1",
)
def fp_dedupe(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumn("title", F.lit(""))
    return first_occurrences(rows).select("session", "ord", "fp")


@registry.add(
    "ingest_anti_join",
    f"""WITH {_STORE} SELECT session, ord, fp FROM fresh f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.session = f.session AND s.fp = f.fp)""",
)
def ingest_anti_join(spark, sf_dir):
    return M.unseen_records(_fresh(spark, sf_dir), _stored(spark, sf_dir)).select("session", "ord", "fp")


@registry.add(
    "backfill_compactions",
    """WITH e AS (SELECT user_id AS session, 'c' || (event_id // 50) AS compaction_id, event_id AS seq, event_type FROM events)
SELECT session, compaction_id, min(seq) AS seq FROM e WHERE NOT EXISTS (
  SELECT 1 FROM e k WHERE k.event_type = 'error' AND k.session = e.session AND k.compaction_id = e.compaction_id)
GROUP BY session, compaction_id""",
)
def backfill_compactions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.concat(F.lit("c"), F.expr("event_id div 50")).alias("compaction_id"),
        F.col("event_id").alias("seq"), "event_type",
    )
    return M.unseen_compactions(events, events.where("event_type = 'error'"))


@registry.add(
    "delete_blocks",
    f"""WITH {_STORE}, c AS (SELECT DISTINCT b.session, b.fp FROM b JOIN labels l ON l.doc_id = b.ord WHERE l.toxic = 1)
SELECT session, ord, fp, EXISTS (SELECT 1 FROM c WHERE c.session = b.session AND c.fp = b.fp) AS deleted FROM b""",
)
def delete_blocks(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("ord"))
    remaining, victims = M.split_deleted(blocks, blocks.join(toxic, "ord", "left_semi"))
    return remaining.withColumn("deleted", F.lit(False)).unionByName(
        victims.withColumn("deleted", F.lit(True))
    ).select("session", "ord", "fp", "deleted")


_TRASH = """trash AS (SELECT *, 't' || (ord // 40) AS trash_id, TIMESTAMP '2024-01-01' + to_hours(CAST(ord // 40 AS INTEGER)) AS deleted_at FROM fresh)"""


def _trash(spark, sf_dir):
    entry = F.expr("ord div 40")
    return _fresh(spark, sf_dir).withColumn(
        "trash_id", F.concat(F.lit("t"), entry.cast("string"))
    ).withColumn("deleted_at", F.timestamp_seconds(F.lit(1704067200) + entry * 3600))


@registry.add(
    "trash_restore_antijoin",
    f"""WITH {_STORE}, {_TRASH}
SELECT session, layer, compaction_id, fp, ord FROM trash t WHERE NOT EXISTS (SELECT 1 FROM stored s
  WHERE (s.session, s.layer, s.compaction_id, s.fp) = (t.session, t.layer, t.compaction_id, t.fp))
QUALIFY row_number() OVER (PARTITION BY session, layer, compaction_id, fp ORDER BY ord) = 1""",
)
def trash_restore_antijoin(spark, sf_dir):
    rows = M.restorable(_trash(spark, sf_dir), _stored(spark, sf_dir))
    return rows.select("session", "layer", "compaction_id", "fp", "ord")


@registry.add(
    "restore_counts",
    f"""WITH {_STORE}, {_TRASH}, g AS (
  SELECT trash_id, session, layer, compaction_id, fp, count(*) AS n, EXISTS (SELECT 1 FROM stored s
    WHERE (s.session, s.layer, s.compaction_id, s.fp) = (t.session, t.layer, t.compaction_id, t.fp)) AS known
  FROM trash t GROUP BY ALL)
SELECT trash_id, count(*) FILTER (WHERE NOT known) AS restored,
  CAST(sum(n - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM g GROUP BY trash_id""",
)
def restore_counts(spark, sf_dir):
    return M.restore_counts(_trash(spark, sf_dir), _stored(spark, sf_dir))


@registry.add(
    "trash_list",
    f"""WITH {_STORE}, {_TRASH} SELECT trash_id, max(session) AS session, strftime(max(deleted_at), '%Y-%m-%d %H:%M:%S') AS deleted_at,
  count(*) AS blocks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM trash GROUP BY trash_id""",
)
def trash_list(spark, sf_dir):
    return M.list_trash(_trash(spark, sf_dir)).withColumn(
        "deleted_at", F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss")
    )


_NOW = "2024-01-08 12:00:00"


@registry.add(
    "retention_filter",
    f"""WITH {_STORE}, {_TRASH}, l AS (SELECT trash_id, max(session) AS session, max(deleted_at) AS deleted_at FROM trash GROUP BY trash_id),
x AS (SELECT * FROM l WHERE deleted_at < TIMESTAMP '{_NOW}' - INTERVAL 7 DAY)
SELECT trash_id, session, NOT EXISTS (SELECT 1 FROM l r WHERE r.session = x.session AND r.trash_id NOT IN (SELECT trash_id FROM x)) AS orphan FROM x""",
)
def retention_filter(spark, sf_dir):
    entries = M.list_trash(_trash(spark, sf_dir))
    expired = M.expired_entries(entries, F.lit(_NOW).cast("timestamp"), 7)
    kept = entries.join(expired.select("trash_id"), "trash_id", "left_anti")
    orphans = M.orphaned_sessions(expired, kept).withColumn("orphan", F.lit(True))
    return expired.join(orphans, "session", "left").select(
        "trash_id", "session", F.coalesce("orphan", F.lit(False)).alias("orphan")
    )


@registry.add(
    "keyword_patch",
    f"""WITH {S.RECORDS}, u AS (SELECT session, fp, min(ord) AS o FROM records r JOIN labels l ON l.doc_id = r.ord WHERE l.quality = 1 GROUP BY session, fp)
SELECT r.session, r.ord, u.fp IS NOT NULL AS patched,
  CASE WHEN u.fp IS NOT NULL THEN 'patched ' || u.o ELSE array_to_string(r.keywords, ' ') END AS keywords
FROM records r LEFT JOIN u USING (session, fp)""",
)
def keyword_patch(spark, sf_dir):
    records = stored_records(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("ord"))
    updates = records.join(good, "ord").groupBy("session", "fp").agg(
        F.array(F.lit("patched"), F.min("ord").cast("string")).alias("keywords")
    )
    return M.patch_keywords(records, updates).select(
        "session", "ord", "patched", F.array_join("keywords", " ").alias("keywords")
    )


@registry.add(
    "log_tail",
    "SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)",
)
def log_tail(spark, sf_dir):
    return M.tail(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 200)


@registry.add(
    "label_pairs",
    f"""WITH {S.BLOCKS} SELECT b."at", b.session, b.text AS query, {_FP} AS fp,
  CASE WHEN l.quality = 1 THEN 'hit' ELSE 'none' END AS verdict, floor(b.ord / 7.0::DOUBLE * 10000 + 0.5) / 10000 AS score,
  b.text AS title FROM blocks b JOIN labels l ON l.doc_id = b.ord""",
)
def label_pairs(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    rows = _blocks(spark, sf_dir).join(labels, "ord").select(
        "at", "session", F.col("text").alias("query"), "fp",
        F.when(F.col("quality") == 1, "hit").otherwise("other").alias("verdict"),
        (F.col("ord") / 7.0).alias("score"), F.col("text").alias("title"),
    )
    return M.label_pairs(rows)


@registry.add(
    "usage_by_day",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS calls, CAST(sum(greatest(k - 20, 0)) AS BIGINT) AS tokens_in,
  CAST(sum(user_id) AS BIGINT) AS tokens_out
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def usage_by_day(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = table(spark, sf_dir, "events").select(
        F.col("ts").alias("at"), (k - 20).alias("tokens_in"), F.col("user_id").alias("tokens_out")
    )
    return M.usage_by_day(calls).withColumn("date", F.col("date").cast("string"))


_ROLL = f"""{S.RECORDS}, roll AS MATERIALIZED (
  SELECT session, count(*) AS blocks, count(*) FILTER (WHERE layer <> 'raw') AS summary_blocks,
    count(*) FILTER (WHERE layer = 'raw') AS raw_blocks, count(DISTINCT compaction_id) AS compactions,
    max(epoch_ms(CAST(left("at", 19) AS TIMESTAMP))) AS activity_ms,
    coalesce(arg_max(title, ord) FILTER (WHERE layer = 'summary' AND title <> ''), arg_max(title, ord)) AS title,
    CAST(sum(strlen(text)) AS BIGINT) AS bytes
  FROM records GROUP BY session)"""
_AT = "2024-01-03 07:30:00"


@registry.add(
    "session_rollup",
    f"""WITH {_ROLL} SELECT session, blocks, summary_blocks, raw_blocks, compactions, activity_ms, title, bytes,
  activity_ms + 2 * 86400000 > epoch_ms(TIMESTAMP '{_AT}') AS protected,
  CAST(greatest(0, ceil((activity_ms + 2 * 86400000 - epoch_ms(TIMESTAMP '{_AT}')) / 86400000)) AS BIGINT) AS protect_days_left FROM roll""",
)
def session_rollup_query(spark, sf_dir):
    out = session_rollup(stored_records(spark, sf_dir), F.lit(_AT).cast("timestamp"), 2)
    return out.drop("updated_ms")


@registry.add(
    "workspace_rollup",
    f"""WITH {_ROLL} SELECT 'w' || right(session, 1) AS workspace, count(*) AS sessions, CAST(sum(blocks) AS BIGINT) AS blocks,
  CAST(sum(bytes) AS BIGINT) AS bytes, max(activity_ms) AS activity_ms FROM roll GROUP BY 1""",
)
def workspace_rollup_query(spark, sf_dir):
    sessions = session_rollup(stored_records(spark, sf_dir), F.lit(_AT).cast("timestamp"), 2)
    return workspace_rollup(
        sessions.withColumn("workspace", F.concat(F.lit("w"), F.right("session", F.lit(1))))
    )
