"""Turning a compaction's turns into size-bounded raw blocks.

Greedy packing is sequential: a chunk closes when the next piece no longer fits. To keep a huge
compaction out of one task, pieces are cut into slices. Within a slice only the position of its
first chunk start is unknown, and a chunk can span few pieces, so each slice becomes a small map
"entry offset -> entry offset of the next slice". Maps are composed in groups of slices, then
across groups; every slice then learns its entry and cuts its pieces on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.sanitize import sanitize
from palimpsest.operators.ordered import SLICE_WIDTH, row_number
from palimpsest.session import settle

SLICE = 2048
GROUP = 2048
PIECE_GAP = 2
PART_ROOM = 1 << 21  # parts per chunk in the order column; a string of 2^31 characters has fewer


def _next_starts(sizes: np.ndarray, count: int, target: int) -> np.ndarray:
    """For each of the first ``count`` pieces, where the chunk opened there ends."""
    ends = np.empty(count, dtype=np.int64)
    totals = np.concatenate([[0], np.cumsum(sizes + PIECE_GAP)])
    for i in range(count):
        fit = int(np.searchsorted(totals, totals[i] + target + PIECE_GAP, side="right")) - 1
        ends[i] = max(i + 1, fit)
    return ends


def _exit_map(target: int):
    @F.pandas_udf("array<int>")
    def exits(sizes: pd.Series, lead: pd.Series) -> pd.Series:
        out = []
        for own, ahead in zip(sizes, lead):
            n = len(own)
            ends = _next_starts(np.concatenate([own, ahead]).astype(np.int64), n, target)
            reach = np.empty(n, dtype=np.int64)
            for i in range(n - 1, -1, -1):
                reach[i] = ends[i] - n if ends[i] >= n else reach[ends[i]]
            out.append(reach.astype(np.int32))
        return pd.Series(out)

    return exits


def _starts(target: int):
    @F.pandas_udf("array<int>")
    def starts(sizes: pd.Series, lead: pd.Series, entry: pd.Series) -> pd.Series:
        """Chunk start of every piece as an offset in the slice; -1 before the first start."""
        out = []
        for own, ahead, first in zip(sizes, lead, entry):
            n = len(own)
            ends = _next_starts(np.concatenate([own, ahead]).astype(np.int64), n, target)
            owner = np.full(n, -1, dtype=np.int32)
            at = int(first)
            while at < n:
                owner[at : min(n, ends[at])] = at
                at = int(ends[at])
            out.append(owner)
        return pd.Series(out)

    return starts


def _walk(maps: F.Column, first: F.Column) -> F.Column:
    """Entries of consecutive maps: the first entry, then each map applied to the last."""
    return F.aggregate(
        maps,
        F.array(first.cast("int")),
        lambda acc, m: F.concat(acc, F.array(F.get(m, F.element_at(acc, -1)))),
    )


def greedy_chunks(pieces: DataFrame, key: str, target: int = V.RAW_TARGET_CHARS) -> DataFrame:
    """Adds ``chunk`` to ``key, n, size`` pieces; ``n`` counts from 0 without gaps.

    A piece joins the open chunk while chunk + gap + piece stays within ``target``.
    """
    # empty pieces still cost their gap, so no chunk spans more; a slice is never shorter than that
    reach = target // PIECE_GAP + 2
    width = max(SLICE, reach)
    by_slice = settle(
        pieces.withColumn("slice", F.expr(f"n div {width}"))
        .groupBy(key, "slice")
        .agg(F.array_sort(F.collect_list(F.struct("n", "size"))).alias("_own"))
        .select(key, "slice", F.transform("_own", lambda p: p["size"]).alias("sizes"))
    )
    following = by_slice.select(
        key, (F.col("slice") - 1).alias("slice"), F.slice("sizes", 1, reach).alias("lead")
    )
    slices = by_slice.join(following, [key, "slice"], "left").withColumn(
        "lead", F.coalesce("lead", F.array().cast("array<int>"))
    )
    maps = slices.select(
        key, "slice", F.expr(f"slice div {GROUP}").alias("grp"),
        F.slice(_exit_map(target)("sizes", "lead"), 1, reach).alias("exits"),
    )
    groups = settle(
        maps.groupBy(key, "grp")
        .agg(F.array_sort(F.collect_list(F.struct("slice", "exits"))).alias("_maps"))
        .withColumn("maps", F.transform("_maps", lambda m: m["exits"]))
    )
    composed = groups.select(
        key, "grp",
        F.transform(
            F.sequence(F.lit(0), F.size(F.get("maps", F.lit(0))) - 1),
            lambda e: F.aggregate("maps", e, lambda at, m: F.get(m, at)),
        ).alias("exits"),
    )
    group_entries = (
        composed.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("grp", "exits"))).alias("_g"))
        .select(
            key, F.posexplode(_walk(F.transform("_g", lambda g: g["exits"]), F.lit(0)))
        )
        .select(key, F.col("pos").cast("bigint").alias("grp"), F.col("col").alias("entry"))
    )
    slice_entries = (
        groups.join(group_entries, [key, "grp"])
        .select(key, "grp", F.posexplode(_walk(F.col("maps"), F.col("entry"))))
        .select(
            key, (F.col("grp") * GROUP + F.col("pos")).alias("slice"), F.col("col").alias("entry")
        )
    )
    # A group's walk ends with the entry of the next group, which that group also reports.
    slice_entries = slice_entries.groupBy(key, "slice").agg(F.max("entry").alias("entry"))
    owned = slices.join(slice_entries, [key, "slice"]).withColumn(
        "owner", _starts(target)("sizes", "lead", "entry")
    )
    last = owned.select(
        key, (F.col("slice") + 1).alias("slice"),
        (F.col("slice") * width + F.element_at("owner", -1)).alias("carried"),
    )
    start = F.col("slice") * width
    return (
        owned.select(key, "slice", "owner")
        .join(last, [key, "slice"], "left")
        .select(key, "slice", "carried", F.posexplode("owner"))
        .select(
            key, (start + F.col("pos")).alias("n"),
            F.when(F.col("col") < 0, F.col("carried")).otherwise(start + F.col("col")).alias("chunk"),
        )
    )


def turn_pieces(turns: DataFrame) -> DataFrame:
    """Each turn as one question/answer piece, numbered from 0 in its compaction."""
    asked = F.concat(F.lit("问："), "user")
    piece = F.when(F.col("assistant") == "", asked).otherwise(
        F.concat(asked, F.lit("\n答："), "assistant")
    )
    return turns.withColumn("piece", piece).withColumn("size", F.length("piece"))


def packed_chunks(turns: DataFrame, key: str) -> DataFrame:
    """``key, chunk, seq, question, text``: turns packed to about 900 characters."""
    numbered = settle(
        row_number(turn_pieces(turns), [key], "seq", "_n").withColumn("n", F.col("_n") - 1)
    )
    placed = numbered.join(greedy_chunks(numbered.select(key, "n", "size"), key), [key, "n"])
    ordered = F.array_sort(F.collect_list(F.struct("n", "piece")))
    return placed.groupBy(key, "chunk").agg(
        F.min("seq").alias("seq"),
        F.min_by("user", "n").alias("question"),
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "\n\n").alias("text"),
    )


def fixed_slices(chunks: DataFrame, key: str, width: int = V.RAW_BLOCK_CHARS) -> DataFrame:
    """Cut over-long chunks every ``width`` characters; only the first part keeps the question."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(width))
    return chunks.where("text <> ''").select(
        key, "chunk", "seq", "question", "text", F.posexplode(starts)
    ).select(
        key, "chunk", F.col("pos").alias("part"), "seq",
        F.when(F.col("pos") == 0, F.col("question")).otherwise("").alias("question"),
        F.col("text").substr(F.col("col") + 1, F.lit(width)).alias("text"),
    )


def stride_sample(
    blocks: DataFrame, key: str, order: str, cap: int, width: int = SLICE_WIDTH
) -> DataFrame:
    """Evenly spaced blocks when a key's total characters exceed ``cap``; all of them otherwise.

    Row i of n is kept when some k < keep has floor(k · n/keep) = i, which each row decides from
    its own position.
    """
    if cap <= 0:
        return blocks
    totals = blocks.groupBy(key).agg(
        F.count("*").alias("_count"), F.sum(F.length("text")).alias("_chars")
    )
    keep = F.greatest(F.lit(1), F.expr(f"_count * {cap} div _chars"))
    placed = row_number(blocks, [key], order, "_pos", width).join(totals, key).withColumn("_keep", keep)
    i = F.col("_pos") - 1
    stride = F.col("_count") / F.col("_keep")
    guess = F.floor(i / stride)
    chosen = F.exists(
        F.array(guess - 1, guess, guess + 1),
        lambda k: (k >= 0)
        & (k < F.col("_keep"))
        & (F.least(F.col("_count") - 1, F.floor(k * stride)) == i),
    )
    return placed.where((F.col("_chars") <= cap) | chosen).drop("_count", "_chars", "_keep", "_pos")


def raw_blocks(turns: DataFrame, key: str, cap: int = 0) -> DataFrame:
    """Turns of a compaction as sanitized raw blocks with a stable order column ``place``.

    All of them, unless ``cap`` asks for an even sample of about so many characters.
    """
    parts = fixed_slices(packed_chunks(turns, key), key)
    placed = parts.withColumn("place", F.col("chunk") * PART_ROOM + F.col("part"))
    numbered = stride_sample(placed, key, "place", cap, SLICE_WIDTH * PART_ROOM)
    return numbered.withColumn("text", sanitize(F.col("text")))


def running_budget(items: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """Keep items in order while they fit; one that does not fit is skipped, later ones may.

    Of the items with one cost, an item can only be kept if every earlier one was, so at most
    floor(budget / cost) per cost can matter. That bounds the rows given to the final fold by the
    budget, not by the data.
    """
    if budget <= 0:
        return items
    w = Window.partitionBy(key, cost).orderBy(order)
    possible = (
        items.select(key, order, cost)
        .withColumn("_same", F.row_number().over(w))
        .where(F.col("_same") <= budget)
        .where(F.col("_same") * F.greatest(F.col(cost), F.lit(1)) <= budget)
    )

    def fold(acc, item):
        fits = acc["used"] + item["cost"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + item["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(item["at"]))).otherwise(acc["kept"]).alias("kept"),
        )

    zero = F.struct(
        F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept")
    )
    entry = F.struct(F.col(order).cast("bigint").alias("at"), F.col(cost).cast("bigint").alias("cost"))
    kept = (
        possible.groupBy(key)
        .agg(F.array_sort(F.collect_list(entry)).alias("_items"))
        .select(key, F.explode(F.aggregate("_items", zero, fold, lambda a: a["kept"])).alias(order))
    )
    return items.join(kept, [key, order], "left_semi")


