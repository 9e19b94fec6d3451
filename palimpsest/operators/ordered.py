"""Ordered operators that never put one key's whole history into a single window.

``order`` columns are dense integers (event ``seq``, record ``ord``), so ``order div width``
cuts a key into slices of at most ``width`` rows. Windows run inside a slice; one small row per
slice carries the state forward. A key with a third of all rows becomes many slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import settle

SLICE_WIDTH = 65536


def slice_of(order: str, width: int) -> Column:
    return F.expr(f"cast(floor({order} / {width}) as bigint)")


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = SLICE_WIDTH
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` within ``keys``."""
    cut = df.withColumn("_slice", slice_of(order, width)).withColumn("_value", value)
    by_slice = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by_slice)
        .agg(F.sum("_value").alias("_total"))
        .select(*by_slice, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*by_slice).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, by_slice)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_slice", "_value", "_inside", "_offset")
    )


def row_number(
    df: DataFrame, keys: list[str], order: str, out: str, width: int = SLICE_WIDTH
) -> DataFrame:
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, width)


def last_before(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = SLICE_WIDTH
) -> DataFrame:
    """Last non-null ``value`` on a strictly earlier row of the same key (an as-of carry)."""
    cut = df.withColumn("_slice", slice_of(order, width)).withColumn("_value", value)
    by_slice = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_value").isNotNull(), F.col(order))
    tails = (
        cut.groupBy(*by_slice)
        .agg(F.max_by("_value", seen).alias("_tail"))
        .select(*by_slice, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    )
    inside = Window.partitionBy(*by_slice).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(tails, by_slice)
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_slice", "_value", "_inside", "_carried")
    )


def exact_rank(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Zero-based position of each row in its key's order, for any sort columns.

    One range shuffle on (keys, order) spreads a hot key over many partitions. The sorted copy is
    settled, because positions and partition totals must come from the same partitioning. Pass
    thin rows: only the keys, the order and an identifier. ``order`` must be total within a key.
    """
    named = [c.alias(f"_row_key{i}") for i, c in enumerate(order)]
    sort = [*keys, *(f"_row_key{i}" for i in range(len(order)))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(
        df.select("*", *named)
        .repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_row_id", F.monotonically_increasing_id())
    ).withColumn("_row_part", F.shiftright("_row_id", 33))
    by_part = [*keys, "_row_part"]
    before = Window.partitionBy(*keys).orderBy("_row_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by_part)
        .agg(F.min("_row_id").alias("_row_first"), F.count("*").alias("_row_count"))
        .select(*by_part, "_row_first", F.coalesce(F.sum("_row_count").over(before), F.lit(0)).alias("_row_offset"))
    )
    return (
        rows.join(starts, by_part)
        .withColumn(out, F.col("_row_id") - F.col("_row_first") + F.col("_row_offset"))
        .drop("_row_part", "_row_id", "_row_first", "_row_offset", *(f"_row_key{i}" for i in range(len(order))))
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """First ``n`` rows per key, numbered from 1.

    The ``row_number() <= n`` filter becomes a group limit below the shuffle, so each map task
    sends at most ``n`` rows per key however large the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
