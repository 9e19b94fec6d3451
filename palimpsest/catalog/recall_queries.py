"""Recall lines, duplicate gates, recall blocks and session recaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.recall_sql import line_ctes
from palimpsest.catalog.search_queries import _index, stored_records
from palimpsest.catalog.tier_queries import _SINGLE_MERGE, _decide_sql
from palimpsest.functions import tokens as K
from palimpsest.operators.recall import format_recall, fresh_hits, recall_line
from palimpsest.operators.recap import _header_tokens, recap, recap_candidates
from palimpsest.operators.similar import similar_pairs
from palimpsest.operators.tiers import two_tier
from palimpsest.session import settle
from palimpsest.sources.tables import document_blocks, questions, table

registry = Registry()


@registry.add(
    "recall_lines",
    f"""WITH {S.RECORDS},
asked AS (SELECT session, ord, title, CASE WHEN ord % 2 = 0 THEN '问：' || title || chr(10) || '答：' || replace(text, '. ', '! ') ELSE text END AS text FROM records),
{line_ctes('asked', 'lines')} SELECT session, ord, line FROM lines""",
)
def recall_lines(spark, sf_dir):
    """A recall line for every document block; half are phrased as question and answer."""
    records = stored_records(spark, sf_dir)
    text = F.when(
        F.col("ord") % 2 == 0,
        F.concat(F.lit("问："), "title", F.lit("\n答："), F.replace("text", F.lit(". "), F.lit("! "))),
    ).otherwise(F.col("text"))
    return records.select(
        "session", "ord", recall_line(F.col("title"), text, 300).alias("line")
    )


def _picked(spark, sf_dir):
    index = _index(spark, sf_dir)
    picked = two_tier(index, questions(spark, sf_dir)).where("picked")
    texts = document_blocks(spark, sf_dir).select("session", "ord", "text")
    return picked.join(texts, ["session", "ord"])


_FIRST_WORDS = 24


@registry.add(
    "similar_records",
    f"""WITH {S.RECORDS},
r AS MATERIALIZED (SELECT session, ord, list_distinct({S.tokens(f"array_to_string(list_slice(string_split(text, ' '), 1, {_FIRST_WORDS}), ' ')")}) AS t FROM records),
p AS (SELECT a.session, a.ord, b.ord AS other, {S.jaccard('a.t', 'b.t')} AS likeness FROM r a JOIN r b ON a.session = b.session AND a.ord < b.ord)
SELECT session, ord, other, round(likeness, 9) AS likeness FROM p WHERE likeness >= {V.NEAR_DUPLICATE}""",
)
def similar_records(spark, sf_dir):
    """Records of one session that begin alike: the first words of each as the line that was shown."""
    begun = F.substring_index("text", " ", _FIRST_WORDS)
    rows = stored_records(spark, sf_dir).select("session", "ord", K.token_set(begun).alias("line"))
    found = similar_pairs(
        rows, None, ["session"], ["ord"], ["other"], "line", V.NEAR_DUPLICATE,
        strict=F.col("ord") < F.col("other"),
    )
    return found.withColumn("likeness", F.round("likeness", 9))


def _shown(spark, sf_dir):
    """What earlier turns showed: the records that a label calls good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("ord")).distinct()
    rows = stored_records(spark, sf_dir).join(good, "ord", "left_semi")
    return rows.select("session", "fp", recall_line(F.col("title"), F.col("text")).alias("line"))


def _queued(picked):
    """Material queued for this turn: per session the text of the first pick of its last question."""
    return picked.where("place = 1").groupBy("session").agg(F.max_by("text", "query_id").alias("boost"))


def _set(x: str) -> str:
    return f"list_distinct({S.tokens(x)})"


_GATED = f"""{S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=True, limit=6)},
{_SINGLE_MERGE}, {_decide_sql()},
picks AS (SELECT d.query_id, d.session, d.ord, d.fp, d.place, r.title, r.text FROM decided d JOIN records r USING (session, ord) WHERE d.picked),
{line_ctes('picks', 'plines')},
goods AS (SELECT r.session, r.fp, r.title, r.text FROM records r WHERE r.ord IN (SELECT doc_id FROM labels WHERE quality = 1)),
{line_ctes('goods', 'shown')},
shown_sets AS MATERIALIZED (SELECT session, fp, {_set('line')} AS t FROM shown),
queued AS MATERIALIZED (SELECT session, {_set('arg_max(text, query_id)')} AS t FROM picks WHERE place = 1 GROUP BY session),
sets AS MATERIALIZED (SELECT p.*, {S.trim("coalesce(p.title, '')")} AS tt, {_set('p.line')} AS lt, {_set('p.text')} AS bt, q.t AS qt
  FROM plines p LEFT JOIN queued q USING (session)),
gates AS MATERIALIZED (SELECT *,
  CASE WHEN EXISTS (SELECT 1 FROM shown_sets x WHERE x.session = s.session AND x.fp = s.fp) THEN 'injected-fp'
    WHEN len(lt) > 0 AND len(qt) > 0 AND len(list_intersect(lt, qt))::DOUBLE / len(lt) >= {V.NEAR_DUPLICATE} THEN 'boost-overlap'
    WHEN EXISTS (SELECT 1 FROM shown_sets x WHERE x.session = s.session AND {S.jaccard('x.t', 's.lt')} >= {V.NEAR_DUPLICATE}) THEN 'injected-text'
  END AS gate FROM sets s),
judged AS MATERIALIZED (SELECT g.*, coalesce(g.gate, CASE WHEN f.query_id IS NULL THEN NULL WHEN g.tt <> '' AND g.tt = f.tt THEN 'same-title'
    WHEN {S.jaccard('g.bt', 'f.bt')} >= {V.NEAR_DUPLICATE} OR {S.jaccard('g.lt', 'f.lt')} >= {V.NEAR_DUPLICATE} THEN 'near-duplicate' END, '') AS reason
  FROM gates g LEFT JOIN gates f ON f.query_id = g.query_id AND f.session = g.session AND f.place = 1 AND g.place = 2 AND f.gate IS NULL)"""


@registry.add("fresh_hits", f"WITH {_GATED} SELECT query_id, session, ord, place, line, reason FROM judged")
def fresh_hits_query(spark, sf_dir):
    """The picks of every question behind all gates: what a label calls good was shown before, and each session
    has material queued."""
    picked = settle(_picked(spark, sf_dir))
    return fresh_hits(picked, injected=_shown(spark, sf_dir), boost=_queued(picked)).select(
        "query_id", "session", "ord", F.col("place").cast("bigint").alias("place"), "line", F.coalesce("drop_reason", F.lit("")).alias("reason")
    )


@registry.add(
    "recall_block",
    f"""WITH {_GATED},
laid AS (SELECT query_id, session, {S.q(V.RECALL_HEADER)} || chr(10) || string_agg('- [对话] ' || line, chr(10) ORDER BY place)
    || chr(10) || {S.q(V.MARKER_END)} AS text, count(*) AS items, string_agg(fp, ' ' ORDER BY place) AS fps
  FROM judged WHERE reason = '' AND trim(line) <> '' GROUP BY query_id, session)
SELECT query_id, session, text, CAST({S.estimate('text')} AS BIGINT) AS tokens, items, fps FROM laid""",
)
def recall_block(spark, sf_dir):
    picked = settle(_picked(spark, sf_dir))
    out = format_recall(fresh_hits(picked, injected=_shown(spark, sf_dir), boost=_queued(picked)))
    return out.select(
        "query_id", "session", "text", F.col("tokens").cast("bigint").alias("tokens"), F.col("items").cast("bigint").alias("items"), "fps"
    )


_CANDIDATES = f"""grouped AS (SELECT session, compaction_id, max("at") AS gat, min(ord) AS go FROM records
  WHERE layer = 'summary' GROUP BY session, compaction_id),
aged AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY gat DESC, go) - 1 AS gr,
  count(*) OVER (PARTITION BY session) AS gn FROM grouped),
cand AS MATERIALIZED (
  SELECT r.session, r.ord, r."at", trim(r.title) AS title, r.text, a.gat, a.go,
    round({S.conclusion('r.text')} * 1.2 + 0.6 + least(0.5, length(trim(r.title)) / 40.0)
      + CASE WHEN regexp_matches(trim(r.title), '^[0-9.、]') THEN -0.2 ELSE 0 END
      + CASE WHEN a.gn <= 1 THEN 0 ELSE 0.15 * (1 - a.gr / (a.gn - 1)) END, 9) AS score
  FROM records r JOIN aged a USING (session, compaction_id)
  WHERE r.layer = 'summary' AND trim(r.title) <> '' AND NOT contains(r.title, '<')
    AND NOT regexp_matches(trim(r.title), '^[A-Za-z]:[\\\\/]') AND length(r.text) >= 80
    AND NOT (length(trim(r.title)) < 6 OR regexp_matches(trim(r.title), '[,，、;；:：]$')
      OR regexp_matches(trim(r.title), '(?i)(into|and|via|with|to|for|of|the)$') OR regexp_matches(trim(r.title), '^[)\\]）】]')
      OR length(regexp_replace(trim(r.title), '[^（(]', '', 'g')) <> length(regexp_replace(trim(r.title), '[^）)]', '', 'g'))))"""


@registry.add(
    "recap_ranking",
    f"WITH {S.RECORDS}, {_CANDIDATES} SELECT session, ord, title, round(score, 6) AS score FROM cand",
)
def recap_ranking(spark, sf_dir):
    return recap_candidates(stored_records(spark, sf_dir)).select(
        "session", "ord", "title", F.round("score", 6).alias("score")
    )


_LINE = S.clean_line("x")


@registry.add(
    "recap_block",
    f"""WITH RECURSIVE {S.RECORDS}, {_CANDIDATES},
said AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE}),
    lambda x: x <> title AND NOT starts_with(x, '问：') AND length(x) >= 8
      AND NOT (length(title) >= 6 AND (starts_with(x, title) OR starts_with(title, x))))[1] AS c FROM cand),
lines AS (SELECT *, '- ' || title || CASE WHEN c IS NULL THEN '' ELSE ' — ' || CASE WHEN length(c) <= 64 THEN c
    ELSE substr(c, 1, 64) || '…' END END AS line FROM said),
ranked AS MATERIALIZED (SELECT session, line, title, "at", {S.estimate('line')} + 1 AS cost,
    row_number() OVER (PARTITION BY session ORDER BY score DESC, "at" DESC, gat DESC, go, ord) AS n FROM lines),
walk AS (
  SELECT session, 0::BIGINT AS n, 0 AS used, []::VARCHAR[] AS titles, []::BIGINT[] AS kept FROM (SELECT DISTINCT session FROM ranked)
  UNION ALL
  SELECT r.session, r.n, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok THEN list_append(titles, title) ELSE titles END,
    CASE WHEN ok THEN list_append(kept, r.n) ELSE kept END
  FROM (SELECT w.used, w.titles, w.kept, x.*, len(w.kept) < 12 AND w.used + x.cost <= {300 - _header_tokens()}
          AND NOT list_contains(w.titles, x.title) AS ok
        FROM walk w JOIN ranked x ON x.session = w.session AND x.n = w.n + 1) r),
final AS (SELECT session, kept FROM walk QUALIFY row_number() OVER (PARTITION BY session ORDER BY n DESC) = 1),
texts AS (SELECT f.session, count(*) AS lines, {S.q(V.RECAP_HEADER)} || chr(10) ||
    string_agg(r.line, chr(10) ORDER BY r."at", r.n) AS text
  FROM final f JOIN ranked r ON r.session = f.session AND list_contains(f.kept, r.n) GROUP BY f.session)
SELECT session, text, {S.estimate('text')}::BIGINT AS tokens, lines FROM texts""",
)
def recap_block(spark, sf_dir):
    out = recap(stored_records(spark, sf_dir))
    return out.select(
        "session", "text", F.col("tokens").cast("bigint").alias("tokens"),
        F.col("lines").cast("bigint").alias("lines"),
    )
