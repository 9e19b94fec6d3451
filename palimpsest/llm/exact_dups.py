"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text.

1. One scan writes two slim values per row: the length in bytes and a hash of the first ``HEAD`` code points.
2. Rows are grouped by length; rows whose length occurs more than once are grouped by (length, head).
3. A second scan reads the rows again. Only those whose (length, head) occurs more than once are read in full
   and hashed (SHA-256 of the normalised text); the others are alone and pass without a shuffle.
4. Survivors are grouped by the full hash and looked up in the groups of more than one row.

Which rows survive a step is told by a bitmap of bounded size (``marks.MAX_BITS``) that every task gets: a set bit of
another key lets a row through that the next step then finds alone, so it costs time, never a wrong answer. Texts
themselves are never shuffled. A group with a thousandth of the survivors or more is joined from a broadcast of
at most a thousand such groups, the rest by a shuffle, so that no copied text fills one task.

Defined results: null text counts as empty; the row with the largest ``key`` of a group stays, a null key being
smaller than any other; of rows that repeat text and key one stays; an empty table gives no rows; columns of the
input beyond ``carry`` are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written
from palimpsest.llm.marks import MAX_BITS, Marks

HEAD = 64
HOT_SHARE = 1000
RESULTS = ("keep_id", "group_size", "kept")


def folded(text: Column) -> Column:
    """``text`` with A-Z lower-cased; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), max_bits: int = MAX_BITS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept and the columns of ``carry``."""
    clash = set(carry) & {key, *RESULTS}
    if clash:
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    whole = folded(F.col(f"`{text}`"))
    length = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    head = F.xxhash64(length, folded(F.substring(F.col(f"`{text}`"), 1, HEAD)))

    slim = written(docs.select(length.alias("length"), head.alias("head")), "lengths")
    lengths = slim.groupBy("length").count().where("count > 1").select("length")
    by_length = slim.where(Marks(lengths, "length", max_bits).may_hold(F.col("length")))
    heads = by_length.groupBy("length", "head").count().where("count > 1").select("head")
    survives = Marks(written(heads, "heads"), "head", max_bits).may_hold(F.col("_head"))

    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in carry]).alias("_carry"),
        F.col(f"`{text}`").alias("_text"), head.alias("_head"),
    )
    refined = written(
        rows.withColumn("_survives", survives)
        .select("_key", "_carry", F.when(F.col("_survives"), F.sha2(folded(F.col("_text")), 256)).alias("_full"))
        .withColumn("_row", F.monotonically_increasing_id()),
        "refined",
    )
    survivors = refined.where(F.col("_full").isNotNull())
    top = F.max(F.struct(F.col("_key").isNotNull().alias("known"), F.col("_key").alias("key"), F.col("_row").alias("row")))
    groups = written(
        survivors.groupBy("_full").agg(top.alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1"), "groups"
    )
    least = max(2, -(-survivors.count() // hot_share))  # at most ``hot_share`` groups are this large
    hot, cold = F.broadcast(groups.where(F.col("size") >= least)), groups.where(F.col("size") < least)
    found = survivors.join(hot, "_full").unionByName(
        survivors.join(hot.select("_full"), "_full", "left_anti").join(cold, "_full", "left"), allowMissingColumns=True
    )
    alone = refined.where(F.col("_full").isNull())
    return found.unionByName(alone, allowMissingColumns=True).select(
        F.col("_key").alias(key), F.when(F.col("size").isNull(), F.col("_key")).otherwise(F.col("top.key")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | (F.col("top.row") == F.col("_row"))).alias("kept"),
        *[F.col("_carry")[c].alias(c) for c in carry],
    )
