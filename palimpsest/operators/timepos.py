"""Time position of blocks in their session and the bounded re-rank built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ordered import exact_rank


@dataclass(frozen=True)
class TimeParams:
    near_peak: float = 1.0
    far_peak: float = 0.0
    bell_peak: float = 0.7
    bell_width: float = 0.35
    both_ends_dip: float = 0.2
    low: float = 0.7
    high: float = 1.35

    def bounded(self) -> TimeParams:
        def clip(v: float, a: float, b: float) -> float:
            return min(b, max(a, v))

        return TimeParams(
            clip(self.near_peak, 0.5, 1), clip(self.far_peak, 0, 0.5),
            clip(self.bell_peak, 0.5, 1), clip(self.bell_width, 0.05, 2),
            clip(self.both_ends_dip, 0, 1), clip(self.low, 0.1, 1), clip(self.high, 1, 3),
        )


def time_positions(blocks: DataFrame) -> DataFrame:
    """``session, ord, position`` in [0, 1] by (time, last seq, ord).

    Blocks with neither time nor seq have no position; blocks with only a seq come first. A
    session with fewer than two placed blocks has no positions.
    """
    placed = blocks.select(
        "session", "ord", F.unix_millis(F.try_to_timestamp("at")).alias("_ms"), "seq_end"
    ).where("_ms is not null or seq_end is not null")
    ranked = exact_rank(
        placed, ["session"], [F.col("_ms"), F.col("seq_end"), F.col("ord")], "_below"
    )
    sizes = placed.groupBy("session").agg(F.count("*").alias("_n")).where("_n > 1")
    return ranked.join(sizes, "session").select(
        "session", "ord", (F.col("_below") / (F.col("_n") - 1)).alias("position")
    )


def coefficient(shape: Column, position: Column, params: TimeParams = TimeParams()) -> Column:
    t = params.bounded()
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), position))
    z = (p - t.bell_peak) / t.bell_width
    old = F.lit(1.0) if t.far_peak >= 1 else F.least(F.lit(1.0), (1 - p) / (1 - t.far_peak))
    shaped = (
        F.when(shape == "new", F.least(F.lit(1.0), p / t.near_peak))
        .when(shape == "old", old)
        .when(shape == "bell", F.exp(-(z * z)))
        .when(shape == "both_ends", 1 - t.both_ends_dip * (4 * p * (1 - p)))
    )
    value = t.low + (t.high - t.low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), shaped))
    return F.when(shape.isNull() | position.isNull() | shaped.isNull(), 1.0).otherwise(value)


def rank_by_intent(
    candidates: DataFrame, positions: DataFrame, params: TimeParams = TimeParams()
) -> DataFrame:
    """Re-order a question's candidates by time intent; the set itself never changes.

    ``candidates``: query_id, session, ord, at, score, rank, shape. Adds lexical_score,
    coefficient, new_rank and moved. Candidates of one question are a bounded top list.
    """
    shaped = (
        candidates.join(positions, ["session", "ord"], "left")
        .withColumn("lexical_score", F.col("score"))
        .withColumn("coefficient", coefficient(F.col("shape"), F.col("position"), params))
        .withColumn("score", F.round(F.col("score") * F.col("coefficient"), 9))
    )
    w = Window.partitionBy("query_id", "session").orderBy(
        F.desc("score"), F.desc(F.coalesce("at", F.lit(""))), "rank"
    )
    return shaped.withColumn(
        "new_rank", F.when(F.col("shape").isNull(), F.col("rank")).otherwise(F.row_number().over(w))
    ).withColumn("moved", F.col("new_rank") != F.col("rank"))
