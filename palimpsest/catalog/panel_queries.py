"""Compositions for a search panel: fallbacks, rewrites, would-inject flags and usage counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.search_queries import _index
from palimpsest.catalog.tier_queries import _SINGLE_MERGE, _decide_sql
from palimpsest.operators import diagnose as D
from palimpsest.operators.rollups import verdict_counts, volume_by_type
from palimpsest.operators.search import search
from palimpsest.operators.tiers import two_tier
from palimpsest.sources.tables import questions, table

registry = Registry()


@registry.add(
    "fallback_candidates",
    f"""WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=False, limit=12)},
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, session, fp ORDER BY rank) = 1)
SELECT query_id, session, ord, fp, row_number() OVER (PARTITION BY query_id, session ORDER BY rank) AS place FROM firsts QUALIFY place <= 3""",
)
def fallback_candidates(spark, sf_dir):
    hits = search(_index(spark, sf_dir), questions(spark, sf_dir), limit=12)
    return D.fallback_candidates(hits).select(
        "query_id", "session", "ord", "fp", F.col("place").cast("bigint").alias("place")
    )


_LONG = r"[A-Za-z]{5,}"


@registry.add(
    "rewrite_candidates",
    f"""WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=False, limit=4)},
rewritten AS (SELECT query_id, segment, session, array_to_string(regexp_extract_all(text, '{_LONG}'), ' ') AS text FROM questions),
{S.search_ctes('rewritten', by_layer=False, limit=8, out='more')},
merged AS (SELECT query_id, session, ord, layer, fp, "at", score, FALSE AS rewritten FROM hits UNION ALL
  SELECT query_id, session, ord, layer, fp, "at", score, TRUE FROM more m
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = m.query_id AND h.session = m.session AND h.fp = m.fp))
SELECT query_id, session, ord, layer, rewritten, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id, session ORDER BY merged.score DESC, "at" DESC, ord) AS place FROM merged QUALIFY place <= 6""",
)
def rewrite_candidates(spark, sf_dir):
    ask = questions(spark, sf_dir)
    long_words = F.array_join(F.regexp_extract_all("text", F.lit(f"({_LONG})"), F.lit(1)), " ")
    hits = search(_index(spark, sf_dir), ask, limit=4)
    more = search(_index(spark, sf_dir), ask.withColumn("text", long_words), limit=8)
    return D.merged_candidates(hits, more, limit=6).select(
        "query_id", "session", "ord", "layer", "rewritten", F.round("score", 6).alias("score"),
        F.col("place").cast("bigint").alias("place"),
    )


@registry.add(
    "panel_search",
    f"WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=True, limit=6)}, "
    f"{_SINGLE_MERGE}, {_decide_sql()} "
    """SELECT query_id, session, layer, ord, place, picked AS injected, round(score, 6) AS score FROM decided WHERE place <= 5""",
)
def panel_search(spark, sf_dir):
    """The five best blocks of each layer and whether the turn would inject them."""
    ranked = two_tier(_index(spark, sf_dir), questions(spark, sf_dir))
    return ranked.where("place <= 5").select(
        "query_id", "session", "layer", "ord", F.col("place").cast("bigint").alias("place"),
        F.col("picked").alias("injected"), F.round("score", 6).alias("score"),
    )


@registry.add(
    "verdict_counts",
    """SELECT lang, count(*) FILTER (WHERE quality = 1) AS hits, count(*) FILTER (WHERE quality <> 1) AS misses,
  count(DISTINCT source) AS sessions FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
)
def verdict_counts_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("session"))
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn(
        "verdict", F.when(F.col("quality") == 1, "hit").otherwise("none")
    )
    return verdict_counts(judged, "lang")


@registry.add(
    "volume_by_role",
    """SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(ceil(count(*) / 8) AS BIGINT) AS batches
FROM conversations GROUP BY role""",
)
def volume_by_role(spark, sf_dir):
    return volume_by_type(table(spark, sf_dir, "conversations"), "role", "text")
