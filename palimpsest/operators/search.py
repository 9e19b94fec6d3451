"""Fielded BM25 with a capped denominator and an evidence gate, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.operators.index import BlockIndex
from palimpsest.operators.ordered import top_per_key
from palimpsest.session import offered, settle

SCORE_DIGITS = 9


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(weight: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    norm = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length / F.when(avgdl == 0, 1.0).otherwise(avgdl))
    return weight * tf * (V.BM25_K1 + 1) / (tf + norm)


def query_terms(queries: DataFrame, min_matched: int | None = None) -> DataFrame:
    """``query_id, segment[, session], token, floor, n_terms``: distinct tokens per segment."""
    ids = [c for c in ("query_id", "segment", "session") if c in queries.columns]
    floor = K.evidence_floor(F.col("text")) if min_matched is None else F.lit(max(0, min_matched))
    return (
        queries.select(*ids, floor.alias("floor"), K.token_set(F.col("text")).alias("_tokens"))
        .select(*ids, "floor", F.size("_tokens").alias("n_terms"), F.explode("_tokens").alias("token"))
    )


def weighted_terms(index: BlockIndex, terms: DataFrame) -> DataFrame:
    """Query terms present in the index with their idf, per session the query is asked in."""
    on = ["session", "token"] if "session" in terms.columns else ["token"]
    return (
        terms.join(index.terms_of(terms), on)
        .join(index.corpus, "session")
        .withColumn("idf", idf(F.col("n"), F.col("df")))
    )


def denominators(weighted: DataFrame, top: int = V.DENOMINATOR_TOP) -> DataFrame:
    """Sum of the ``top`` largest idfs of each query (all of them when ``top`` is 0)."""
    ids = [c for c in ("query_id", "segment", "session") if c in weighted.columns]
    values = F.sort_array(F.collect_list("idf"), asc=False)
    kept = F.slice(values, 1, top) if top > 0 else values
    return (
        weighted.groupBy(*ids, "floor", "n_terms")
        .agg(
            F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("denominator"),
            F.count("*").alias("matchable"),
        )
        .where("denominator > 0")
    )


def search(
    index: BlockIndex,
    queries: DataFrame,
    *,
    limit: int = 8,
    per_layer: bool = False,
    layers: list[str] | None = None,
    min_matched: int | None = None,
    top_idf: int = V.DENOMINATOR_TOP,
    boost: float = 1.0,
) -> DataFrame:
    """Best blocks per query and session (and per layer when ``per_layer``).

    ``queries``: query_id, text, optional segment and session. Without a session column every
    query is asked in each session that knows one of its words. Document frequencies always
    count both layers; ``layers`` only restricts the candidates.
    """
    if "segment" not in queries.columns:
        queries = queries.withColumn("segment", F.lit(0))
    weighted = settle(weighted_terms(index, query_terms(queries, min_matched)))
    side = offered(weighted.select("query_id", "segment", "session", "token", "idf", "avgdl"))
    postings = index.postings
    if layers is not None:
        postings = postings.where(F.col("layer").isin(layers))
    ids = ["query_id", "segment", "session"]
    gathered = (
        postings.join(side, ["session", "token"])
        .groupBy(*ids, "ord", "layer")
        .agg(
            F.sum(bm25_term(F.col("idf"), F.col("tf"), F.col("len"), F.col("avgdl"))).alias("raw"),
            F.count("*").alias("matched"),
        )
    )
    scored = (
        gathered.join(denominators(weighted, top_idf), ids)
        .where("matched >= floor")
        .join(
            index.blocks.select(
                "session", "ord", "fp", "at", "title", "concl", "src", "tool", "blank",
                "compaction_id", "seq_end",
            ),
            ["session", "ord"],
        )
        .withColumn(
            "score",
            F.round(
                F.col("raw") / F.col("denominator") * boost
                * (1 + V.CONCLUSION_BOOST * F.col("concl")),
                SCORE_DIGITS,
            ),
        )
    )
    keys = [*ids, "layer"] if per_layer else ids
    order = [F.desc("score"), F.desc(F.coalesce("at", F.lit(""))), F.asc("ord")]
    return top_per_key(scored, keys, order, limit, "rank")
