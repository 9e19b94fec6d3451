"""Tier decisions, segmentation, time positions and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.search_queries import _index, stored_records
from palimpsest.operators.ordered import top_per_key
from palimpsest.operators.search import search
from palimpsest.operators.tiers import decisions, segmented, segments_of, two_tier
from palimpsest.operators.timepos import rank_by_intent, time_positions
from palimpsest.sources.tables import questions
from palimpsest.operators.index import block_stats
from palimpsest.operators.records import first_occurrences

registry = Registry()

# Questions that mention a time: the item id chooses the phrase, the text stays whole.
_TIMED = """timed AS (
  SELECT item_id AS query_id, 0 AS segment, 'src' || (item_id % 20) AS session, CASE item_id % 4 WHEN 0 THEN 'earliest ' WHEN 1 THEN 'just now '
    WHEN 2 THEN 'before ' ELSE '' END || text AS text FROM benchmark)"""


def timed_questions(spark, sf_dir):
    phrase = (
        F.when(F.col("query_id") % 4 == 0, "earliest ")
        .when(F.col("query_id") % 4 == 1, "just now ")
        .when(F.col("query_id") % 4 == 2, "before ")
        .otherwise("")
    )
    return questions(spark, sf_dir).withColumn("text", F.concat(phrase, "text"))


# Questions with several clauses: sentence stops become semicolons.
_CLAUSES = """clauses_q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS session,
  replace(text, '. ', '; ') AS text FROM benchmark)"""


def clause_questions(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("; ")))


def _segment_ctes(source: str) -> str:
    """Clause folding for texts without question marks: the state is placed units + open piece."""
    pieces = (
        f"flatten(list_transform({S.sentences('text')}, "
        "lambda s: regexp_extract_all(s, '(?s)[^：:、；;]*[：:、；;]|[^：:、；;]+')))"
    )
    merged = "CASE WHEN regexp_extract(a, '[^\u0002]*$') = '' THEN p ELSE regexp_extract(a, '[^\u0002]*$') || ' ' || p END"
    placed = "regexp_replace(a, '[^\u0002]*$', '')"
    fold = (
        f"list_reduce(list_prepend('', cs), lambda a, p: {placed} || {merged} || "
        f"CASE WHEN length({merged}) < 6 THEN '' ELSE '\u0002' END)"
    )
    return f"""
{source}_cs AS MATERIALIZED (SELECT query_id, session, text, {pieces} AS cs FROM {source}),
{source}_fold AS MATERIALIZED (SELECT query_id, session, text, cs, {fold} AS f FROM {source}_cs),
{source}_units AS (
  SELECT query_id, session, CASE WHEN len(cs) <= 1 THEN [{S.trim('text')}]
    ELSE list_filter(string_split(regexp_replace(f, '\u0002([^\u0002]+)$', ' \\1'), '\u0002'), lambda u: {S.trim('u')} <> '') END AS us
  FROM {source}_fold),
segments AS MATERIALIZED (
  SELECT query_id, session, unnest(range(len(us))) AS segment, unnest(us) AS text FROM {source}_units)"""


def _decide_sql(extra_shape: str = "NULL::VARCHAR", pos: bool = False) -> str:
    """CTE ``decided`` over ``merged`` (query_id, session, layer, fp, ord, at, score, seen_s, seen_r)."""
    coef = """CASE WHEN shape IS NULL OR position IS NULL THEN 1.0::DOUBLE ELSE 0.7 + 0.65 * CASE shape
      WHEN 'new' THEN least(1.0, position) WHEN 'old' THEN least(1.0, 1 - position)
      WHEN 'bell' THEN exp(-(((position - 0.7) / 0.35) * ((position - 0.7) / 0.35)))
      ELSE 1 - 0.2 * (4 * position * (1 - position)) END END"""
    join = "LEFT JOIN positions p USING (session, ord)" if pos else ""
    position = "p.position" if pos else "NULL::DOUBLE"
    return f"""
shaped AS (SELECT m.*, {extra_shape} AS shape, {position} AS position FROM merged m {join}),
lexed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, session, layer ORDER BY score DESC, "at" DESC, seen_s, seen_r) AS lex
  FROM shaped),
tops AS (
  SELECT query_id, session,
    coalesce(max(CASE WHEN layer = 'summary' AND lex = 1 THEN score END), 0) AS st,
    coalesce(max(CASE WHEN layer = 'summary' AND lex = 2 THEN score END), 0) AS ss,
    coalesce(max(CASE WHEN layer = 'raw' AND lex = 1 THEN score END), 0) * 0.85 AS rt,
    coalesce(max(CASE WHEN layer = 'raw' AND lex = 2 THEN score END), 0) * 0.85 AS rs
  FROM lexed GROUP BY query_id, session),
tiers AS (
  SELECT *, CASE WHEN st >= 0.28 AND st >= rt THEN 'summary' WHEN rt >= 0.28 THEN 'raw' ELSE 'none' END AS tier
  FROM tops),
coefs AS (
  SELECT l.*, t.tier, t.st, t.ss, t.rt, t.rs, {coef} AS coefficient FROM lexed l JOIN tiers t USING (query_id, session)),
rescored AS (SELECT * EXCLUDE (score), score AS lexical_score, round(score * coefficient, 9) AS score FROM coefs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, session, layer ORDER BY score DESC,
      CASE WHEN shape IS NOT NULL THEN "at" END, CASE WHEN shape IS NULL THEN "at" END DESC, seen_s, seen_r) AS place,
    max(score) OVER (PARTITION BY query_id, session, layer) AS first_score
  FROM rescored),
decided AS (
  SELECT *, layer = tier AND (place = 1 OR (place = 2 AND score >= first_score * 0.72
      AND lexical_score >= CASE WHEN tier = 'raw' THEN 0.28 / 0.85 ELSE 0.28 END)) AS picked
  FROM placed)"""


_SINGLE_MERGE = """merged AS (SELECT query_id, session, layer, fp, ord, "at", score, segment AS seen_s, rank AS seen_r FROM hits)"""
_PICK_COLS = """SELECT query_id, session, tier, layer, ord, fp, place, round(lexical_score, 6) AS lexical_score,
  round(score, 6) AS score FROM decided WHERE picked"""


def _picks(ranked):
    return ranked.where("picked").select(
        "query_id", "session", "tier", "layer", "ord", "fp",
        F.col("place").cast("bigint").alias("place"),
        F.round("lexical_score", 6).alias("lexical_score"), F.round("score", 6).alias("score"),
    )


@registry.add(
    "bm25_two_tier",
    f"WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=True, limit=6)}, "
    f"{_SINGLE_MERGE}, {_decide_sql()} {_PICK_COLS}",
)
def bm25_two_tier(spark, sf_dir):
    return _picks(two_tier(_index(spark, sf_dir), questions(spark, sf_dir)))


@registry.add(
    "tier_decision",
    f"WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=True, limit=6)}, "
    f"{_SINGLE_MERGE}, {_decide_sql()} "
    """SELECT query_id, session, tier, round(max(CASE tier WHEN 'summary' THEN st WHEN 'raw' THEN rt
      ELSE greatest(st, rt) END), 6) AS lexical_top,
  round(max(CASE tier WHEN 'summary' THEN ss WHEN 'raw' THEN rs ELSE greatest(ss, rs) END), 6) AS second_score,
  CAST(sum(CASE WHEN layer = tier THEN 1 ELSE 0 END) AS BIGINT) AS candidates,
  CAST(sum(CAST(picked AS INTEGER)) AS BIGINT) AS picked FROM decided GROUP BY query_id, session, tier""",
)
def tier_decision(spark, sf_dir):
    out = decisions(two_tier(_index(spark, sf_dir), questions(spark, sf_dir)))
    return out.select(
        "query_id", "session", "tier", F.round("lexical_top", 6).alias("lexical_top"),
        F.round("second_score", 6).alias("second_score"), "candidates", "picked",
    )


@registry.add(
    "segment_query",
    f"WITH {_CLAUSES}, {_segment_ctes('clauses_q')} "
    "SELECT query_id, CAST(segment AS BIGINT) AS segment, text FROM segments",
)
def segment_query(spark, sf_dir):
    return segments_of(clause_questions(spark, sf_dir)).select(
        "query_id", F.col("segment").cast("bigint").alias("segment"), "text"
    )


@registry.add(
    "segmented_retrieval",
    f"WITH {S.INDEX}, {_CLAUSES}, {_segment_ctes('clauses_q')}, "
    f"{S.search_ctes('segments', by_layer=True, limit=6)}, "
    """merged AS (
  SELECT query_id, session, layer, fp, arg_max(ord, (score, -segment, -rank)) AS ord,
    arg_max("at", (score, -segment, -rank)) AS "at", max(score) AS score,
    min((segment, rank))[1] AS seen_s, min((segment, rank))[2] AS seen_r
  FROM hits GROUP BY query_id, session, layer, fp), """
    f"{_decide_sql()} {_PICK_COLS}",
)
def segmented_retrieval(spark, sf_dir):
    return _picks(segmented(_index(spark, sf_dir), clause_questions(spark, sf_dir)))


_POSITIONS = """positions AS MATERIALIZED (
  SELECT session, ord, percent_rank() OVER (PARTITION BY session ORDER BY "at", seq_end, ord) AS position FROM {src})"""


@registry.add(
    "time_position",
    f"WITH {S.RECORDS}, kept AS (SELECT * FROM records QUALIFY row_number() OVER "
    f"(PARTITION BY session, fp ORDER BY ord) = 1), {_POSITIONS.format(src='kept')} "
    "SELECT session, ord, round(position, 6) AS position FROM positions",
)
def time_position(spark, sf_dir):
    blocks = block_stats(first_occurrences(stored_records(spark, sf_dir)))
    return time_positions(blocks).select("session", "ord", F.round("position", 6).alias("position"))


@registry.add(
    "time_rerank",
    f"WITH {S.INDEX}, {_TIMED}, {S.search_ctes('timed', by_layer=True, limit=6)}, {_SINGLE_MERGE}, "
    f"{_POSITIONS.format(src='stats')}, "
    f"{_decide_sql('(SELECT ' + S.time_shape('t.text') + ' FROM timed t WHERE t.query_id = m.query_id)', True)} "
    f"{_PICK_COLS}",
)
def time_rerank(spark, sf_dir):
    return _picks(segmented(_index(spark, sf_dir), timed_questions(spark, sf_dir)))


@registry.add(
    "intent_rerank",
    f"WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=False, limit=12)}, "
    f"{_POSITIONS.format(src='stats')}, "
    """shaped AS (
  SELECT h.*, p.position, CASE query_id % 3 WHEN 0 THEN 'both_ends' WHEN 1 THEN 'old' ELSE 'new' END AS shape
  FROM hits h JOIN positions p USING (session, ord)),
coefs AS (
  SELECT *, round(score * (0.7 + 0.65 * CASE shape WHEN 'new' THEN position WHEN 'old' THEN 1 - position
    ELSE 1 - 0.2 * (4 * position * (1 - position)) END), 9) AS new_score FROM shaped),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY new_score DESC, "at" DESC, rank) AS new_rank
  FROM coefs)
SELECT query_id, session, ord, rank, new_rank, new_rank <> rank AS moved, round(new_score, 6) AS score FROM ranked""",
)
def intent_rerank(spark, sf_dir):
    index = _index(spark, sf_dir)
    hits = search(index, questions(spark, sf_dir), limit=12).withColumn(
        "shape",
        F.when(F.col("query_id") % 3 == 0, "both_ends")
        .when(F.col("query_id") % 3 == 1, "old").otherwise("new"),
    )
    out = rank_by_intent(hits, time_positions(index.blocks))
    return out.select(
        "query_id", "session", "ord", F.col("rank").cast("bigint").alias("rank"),
        F.col("new_rank").cast("bigint").alias("new_rank"), "moved",
        F.round("score", 6).alias("score"),
    )
