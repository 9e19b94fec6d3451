"""Two-tier decision, segmented retrieval and the pick of at most two blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.sentences import query_segments
from palimpsest.functions.timewords import time_shape
from palimpsest.operators.index import BlockIndex
from palimpsest.operators.search import search
from palimpsest.operators.timepos import TimeParams, coefficient, time_positions

ASK = ["query_id", "session"]


def segments_of(queries: DataFrame) -> DataFrame:
    """One row per search unit of each question."""
    ids = [c for c in queries.columns if c != "text"]
    return queries.select(*ids, F.posexplode(query_segments(F.col("text")))).select(
        *ids, F.col("pos").alias("segment"), F.col("col").alias("text")
    )


def merge_segments(hits: DataFrame) -> DataFrame:
    """Best score per block over a question's segments; the first segment wins a tie."""
    fields = [c for c in hits.columns if c not in {*ASK, "layer", "fp"}]
    best = F.max_by(
        F.struct(*fields), F.struct("score", -F.col("segment"), -F.col("rank"))
    ).alias("_best")
    return (
        hits.groupBy(*ASK, "layer", "fp")
        .agg(best, F.min(F.struct("segment", "rank")).alias("seen"))
        .select(*ASK, "layer", "fp", "seen", "_best.*")
    )


def _ordered(score: str, earlier: Column) -> list[Column]:
    at = F.coalesce(F.col("at"), F.lit(""))
    return [F.desc(score), F.asc(F.when(earlier, at)), F.desc(F.when(~earlier, at)), F.asc("seen")]


def decide(
    hits: DataFrame,
    *,
    min_score: float = 0.28,
    max_items: int = 2,
    positions: DataFrame | None = None,
    params: TimeParams = TimeParams(),
    prefer_earlier: bool = False,
) -> DataFrame:
    """Choose the layer per question, re-rank inside it, and pick one or two blocks.

    ``hits``: query_id, session, layer, fp, score, at, seen, optional shape; at most a few per
    layer and segment. Eligibility looks at lexical scores only; time can only re-order. Returns
    every hit with tier, tops, lexical_score, place and picked.
    """
    if "shape" not in hits.columns:
        hits = hits.withColumn("shape", F.lit(None).cast("string"))
    layer = Window.partitionBy(*ASK, "layer").orderBy(*_ordered("score", F.lit(False)))
    ask = Window.partitionBy(*ASK)

    def nth(name: str, n: int) -> Column:
        hit = F.when((F.col("layer") == name) & (F.col("_lex") == n), F.col("score"))
        scale = V.RAW_PENALTY if name == "raw" else 1.0
        return F.coalesce(F.max(hit).over(ask), F.lit(0.0)) * scale

    tops = hits.withColumn("_lex", F.row_number().over(layer)).withColumns({
        "summary_top": nth("summary", 1), "summary_second": nth("summary", 2),
        "raw_top": nth("raw", 1), "raw_second": nth("raw", 2),
    })
    tier = (
        F.when((F.col("summary_top") >= min_score) & (F.col("summary_top") >= F.col("raw_top")),
               "summary")
        .when(F.col("raw_top") >= min_score, "raw")
        .otherwise("none")
    )
    tiered = tops.withColumn("tier", tier).withColumn(
        "lexical_top",
        F.when(F.col("tier") == "summary", F.col("summary_top"))
        .when(F.col("tier") == "raw", F.col("raw_top"))
        .otherwise(F.greatest("summary_top", "raw_top")),
    )
    if positions is not None:
        tiered = tiered.join(positions, ["session", "ord"], "left").withColumn(
            "coefficient", coefficient(F.col("shape"), F.col("position"), params)
        )
    else:
        tiered = tiered.withColumn("coefficient", F.lit(1.0))
    earlier = F.col("shape").isNotNull() | F.lit(prefer_earlier)
    place = Window.partitionBy(*ASK, "layer").orderBy(*_ordered("score", earlier))
    ranked = (
        tiered.withColumn("lexical_score", F.col("score"))
        .withColumn("score", F.round(F.col("score") * F.col("coefficient"), 9))
        .withColumn("place", F.row_number().over(place))
        .withColumn("_first", F.max("score").over(Window.partitionBy(*ASK, "layer")))
    )
    bar = F.when(F.col("tier") == "raw", min_score / V.RAW_PENALTY).otherwise(min_score)
    second = (F.col("place") == 2) & (F.col("lexical_score") >= bar) & (
        F.col("score") >= F.col("_first") * V.SECOND_RATIO
    )
    picked = (F.col("layer") == F.col("tier")) & (
        ((F.col("place") == 1) & F.lit(max_items >= 1)) | (second & F.lit(max_items >= 2))
    )
    return ranked.withColumn("picked", picked).drop("_lex", "_first")


def two_tier(
    index: BlockIndex, queries: DataFrame, *, min_score: float = 0.28, max_items: int = 2,
    prefer_summary: bool = True, top_idf: int = V.DENOMINATOR_TOP,
) -> DataFrame:
    hits = search(
        index, queries, limit=V.PER_LAYER_LIMIT, per_layer=True, top_idf=top_idf,
        layers=None if prefer_summary else ["raw"],
    ).withColumn("seen", F.struct("segment", "rank"))
    return decide(hits, min_score=min_score, max_items=max_items)


def segmented(
    index: BlockIndex, queries: DataFrame, *, min_score: float = 0.28, max_items: int = 2,
    prefer_summary: bool = True, time_boost: bool = True, top_idf: int = V.DENOMINATOR_TOP,
    params: TimeParams = TimeParams(),
) -> DataFrame:
    """Search every segment on its own, merge per block, decide, then re-rank by time."""
    shape = time_shape(F.col("text")) if time_boost else F.lit(None).cast("string")
    shapes = queries.select(
        "query_id", *(["session"] if "session" in queries.columns else []), shape.alias("shape")
    )
    hits = search(
        index, segments_of(queries), limit=V.PER_LAYER_LIMIT, per_layer=True, top_idf=top_idf,
        layers=None if prefer_summary else ["raw"],
    )
    on = [c for c in shapes.columns if c != "shape"]
    merged = merge_segments(hits).join(shapes, on)
    positions = time_positions(index.blocks) if time_boost else None
    return decide(
        merged, min_score=min_score, max_items=max_items, positions=positions, params=params
    )


def decisions(ranked: DataFrame) -> DataFrame:
    """One row per question and session: the tier and its scores after the re-rank."""
    chosen = F.col("layer") == F.col("tier")
    scale = F.when(F.col("tier") == "raw", V.RAW_PENALTY).otherwise(1.0)

    def at_place(n: int) -> Column:
        return F.max(F.when(chosen & (F.col("place") == n), F.col("score") * scale))

    fallback = F.greatest(F.max("summary_second"), F.max("raw_second"))
    none = F.col("tier") == "none"
    return ranked.groupBy(*ASK, "tier", "shape").agg(
        F.max("lexical_top").alias("lexical_top"),
        F.when(none, F.max("lexical_top")).otherwise(at_place(1)).alias("top_score"),
        F.when(none, fallback).otherwise(F.coalesce(at_place(2), F.lit(0.0))).alias("second_score"),
        F.sum(F.when(chosen, 1).otherwise(0)).alias("candidates"),
        F.sum(F.col("picked").cast("int")).alias("picked"),
    )
