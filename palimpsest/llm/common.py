"""Helpers of this subpackage: shared scratch tables, salted running sums, ordered parts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode where none is set."""
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="palimpsest-llm-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the cut in the lineage."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_slice: int = 4096
) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys``, over slices of bounded size.

    A key's rows are ordered by (hash slice, ``order``); the number of slices follows the row count
    alone, so a rerun gives the same sums and a hot key never meets in one task. Rows that tie on
    ``order`` must be interchangeable.
    """
    slices = max(1, math.ceil(df.count() / rows_per_slice))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    by = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*by)
        .agg(F.sum(value).alias("_total"))
        .select(*by, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = same[0]
    for more in same[1:]:
        on = on & more
    return (
        summed.alias("a").join(starts.alias("b"), on)
        .select("a.*", F.col("b._offset"))
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_slice", "_inside", "_offset")
    )


def order_bounds(df: DataFrame, key: str, parts: int) -> list[float]:
    """Ascending cut points that deal ``key`` into about ``parts`` equal ranges.

    One slim pass reads the key alone; the driver gets one number per range, never a row.
    """
    if parts <= 1:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 10 * parts).alias("b")).first()["b"]
    return sorted({float(b) for b in found or []})


def order_part(key: str, bounds: list[float]) -> Column:
    """Number of the range that holds ``key``; nulls come first, as range -1.

    The search is a balanced tree of comparisons, so its depth grows with the logarithm.
    """
    value = F.col(key).cast("double")

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def order_parts(spark: SparkSession) -> int:
    """Ranges for ordered work: several per shuffle partition, so hashing them deals evenly."""
    return min(4 * shuffle_width(spark), 4000)
