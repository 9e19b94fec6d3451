"""Mixing sources to target weights.

Each source's words form one stream, cut into blocks of ``block`` words; a document covers an interval of
its stream. The output is a row of shards with a fixed number of block slots. Per shard the slots are dealt
to sources by a multinomial draw of the fractions that the exact shares leave open (each source first gets
the whole number of slots that its running share has reached), so the mix stays within a few blocks of its
targets at any size. A source's n-th slot takes the block at place n mod B of a pseudorandom permutation of
its B blocks, keyed by source and pass; blocks and documents are then joined by block number, in stretches of
``STRETCH`` blocks, by a shuffle: the slots grow with the input and are never broadcast.

``targets`` deals the sum of all sizes by weight; no source gets more than ``limit`` times its size, and what
is over goes to the others by weight, again and again: that is one level L with sum(min(limit * size, L *
weight)) equal to the total.

All steps are grouping, windows over bounded slices and joins on (source, block). The shares of the sources
are the only thing every task gets; ``MAX_SOURCES`` bounds them and more are refused. Reruns draw the same
mix: every choice depends on names, numbers and the seed alone.

Defined results: null text has no words; documents without words take nothing; a null source is a source of
its own, last in order; repeated rows are separate documents (one unit of equal rows, taken apart copy by copy); an empty table gives no rows. The tail of a
stream is a shorter block; a slot that lands there takes fewer words, and ``limit`` passes over all blocks
are never exceeded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import salted_running_sum, written
from palimpsest.operators.ordered import running_sum

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
BLOCK = 64
STRETCH = 128
SLOTS_AT_ONCE = 100_000
SHARD_SLOTS = 4096
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 4
MAX_SOURCES = 1_000_000
SEED = 20240101


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, place (in code point order, null last), target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))
    )
    # sources stop at their bound in the order of bound per weight; the rest share what is left
    order = Window.orderBy("ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = (
        ranked.withColumn("bound", (limit * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("level", (
            F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
        ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    return levelled.select(
        "source", "source_size", F.col("place").cast("int").alias("place"),
        F.least("bound", F.col("level") * F.col("weight")).alias("target"),
    )



def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each ``index`` in a pseudorandom permutation of 0 .. ``count`` - 1 chosen by ``key``.

    A keyed Feistel network over the smallest even number of bits that holds ``count``; a value outside the
    range walks on along its cycle until it is inside, at most a few steps on average.
    """
    with np.errstate(over="ignore"):
        value, count, key = (np.asarray(a).astype(np.uint64) for a in (index, count, key))
        half = np.maximum(1, np.ceil(np.log2(np.maximum(count, 2).astype(np.float64)) / 2)).astype(np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, todo = value.copy(), np.arange(len(value))
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(ROUNDS):
                left, right = right, left ^ (_mix(right + _mix(k + np.uint64(r + 1))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= count[todo]]
        return out.astype(np.int64)


def streams(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, print (hash of the text), copy, size and start, the words
    of its source before it."""
    units = written(
        docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("print"), word_count(F.col(text)).alias("size"))
        .groupBy("doc_id", "source", "print", "size").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("words", F.col("size") * F.col("copies")),
        "units",
    )
    placed = salted_running_sum(units, ["source"], ["doc_id", "print"], "words", "start")
    return placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "doc_id", "source", "print", "copy", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("start")
    )


def shares(aims: DataFrame, block: int) -> pd.DataFrame:
    """place, blocks and expected slots of every source with words; bounded by ``MAX_SOURCES``."""
    some = aims.where("source_size > 0").select(
        "place", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"), "source_size", "target"
    ).limit(MAX_SOURCES + 1).toPandas().sort_values("place")
    if len(some) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: merge them first")
    some["slots"] = some["target"] * some["blocks"] / some["source_size"]
    return some


def slots(docs: DataFrame, mix: pd.DataFrame, limit: int = LIMIT, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, place, nth, pass, block): the block that every slot of every output shard takes."""
    spark = docs.sparkSession
    expected, places = mix["slots"].to_numpy(float), mix["place"].to_numpy(np.int64)
    blocks = dict(zip(places.tolist(), mix["blocks"].tolist()))
    total = expected.sum()
    shards = max(1, math.ceil(total / shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                part = expected / total * (min(total, (shard + 1) * shard_slots) - shard * shard_slots) if total else expected
                whole = np.floor(part)
                open_ = part - whole
                left = int(round(open_.sum()))
                counts = whole.astype(np.int64)
                if left:
                    counts += np.random.default_rng([seed, shard]).multinomial(left, open_ / open_.sum())
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"place": places[some], "shard": shard, "n": counts[some]})

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, n, shard = (batch[c].to_numpy(np.int64) for c in ("place", "n", "shard"))
            first = batch["before"].to_numpy(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // SLOTS_AT_ONCE)) + 1).tolist(), len(n)]
            for lo, hi in zip(cuts, cuts[1:]):
                k = n[lo:hi]
                nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - first[lo:hi], k)
                here = np.repeat(place[lo:hi], k)
                count = np.array([blocks[p] for p in place[lo:hi].tolist()], np.int64).repeat(k)
                turn = nth // count if len(nth) else nth
                ok = turn < limit
                here, nth, count, turn, at = (a[ok] for a in (here, nth, count, turn, np.repeat(shard[lo:hi], k)))
                with np.errstate(over="ignore"):
                    key = _mix(np.uint64(seed) + _mix(here.astype(np.uint64) * np.uint64(64) + turn.astype(np.uint64)))
                yield pd.DataFrame({
                    "shard": at, "place": here, "nth": nth, "turn": turn, "block": permuted(nth % np.maximum(count, 1), count, key),
                })

    drawn = written(spark.range(shards).mapInPandas(draw, "place long, shard long, n long"), "draws")
    counted = running_sum(drawn, ["place"], "shard", F.col("n"), "through").withColumn("before", F.col("through") - F.col("n"))
    return counted.select("place", "n", "shard", "before").mapInPandas(
        expand, "shard long, place long, nth long, turn long, block long"
    )


def pieces(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, **names) -> DataFrame:
    """Each document's parts by block: the columns of ``streams``, source_size, target, low, high (words of
    the document) and times, how often the mix takes that part. Documents without words have one empty part."""
    rows = written(streams(docs, **names), "streams")
    aims = written(targets(rows, weights, limit), "targets")
    taken = (
        slots(docs, shares(aims, block), limit).withColumn("stretch", F.floor(F.col("block") / STRETCH))
        .repartition("place", "stretch").groupBy("place", "stretch", "block").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("place", "stretch").agg(F.map_from_entries(F.collect_list(F.struct("block", "times"))).alias("_times"))
    )
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    low, high = F.col("stretch") * STRETCH, F.col("stretch") * STRETCH + STRETCH - 1
    # documents without words lie in no block; they are dealt out among numbers that no stretch has
    nowhere = F.array(-1 - F.pmod(F.xxhash64("doc_id", "print", "copy"), F.lit(4096)))
    spans = (
        rows.alias("r").join(aims.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select("r.*", "t.source_size", "t.target", F.col("t.place").cast("long").alias("place"))
        .withColumn("stretch", F.explode(F.when(
            F.col("size") > 0, F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH))
        ).otherwise(nowhere)))
    )
    # what Spark expects of the slots comes from the draws, a few kB at any size, so the join is not left to its size check
    return (
        spans.join(taken.hint("merge"), ["place", "stretch"], "left")
        .withColumn("block", F.explode_outer(F.when(
            F.col("size") > 0, F.sequence(F.greatest(first, low), F.least(last, high))
        )))
        .withColumns({
            "low": F.greatest(F.col("start"), F.col("block") * block) - F.col("start"),
            "high": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start"),
            "times": F.coalesce(F.element_at("_times", F.col("block")), F.lit(0)),
        })
        .drop("stretch", "_times")
    )


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    words = F.coalesce((F.col("high") - F.col("low")) * F.col("times"), F.lit(0))
    return (
        pieces(docs, **how).groupBy("doc_id", "source", "print", "copy", "size", "source_size", "target")
        .agg(F.sum(words).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` as the mix takes them: each document's text holds the words of its taken blocks, pass by pass,
    joined by spaces (whole and unchanged where a pass takes all of them); what is not taken goes.

    n_chars, where there, counts the new text.
    """
    # one column of one type holds the keys, null ones too, so that grouping and join need one shuffle of the texts
    unit = lambda key, text_print: F.struct(key.alias("id"), F.coalesce(text_print, F.lit(0)).alias("print")).alias("_unit")
    parts = (
        pieces(docs, text=text, key=key, **how).where("times > 0")
        .groupBy(unit(F.col("doc_id"), F.col("print")), F.col("copy").alias("_copy"))
        .agg(F.collect_list(F.struct("low", "high", "times")).alias("_parts"))
    )
    cols = [F.col(f"`{c}`") for c in docs.columns]
    units = (
        docs.select(unit(F.col(key), F.xxhash64(text)), F.struct(*cols).alias("_row"))
        .groupBy("_unit").agg(F.first("_row").alias("_row"))
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(texts, parts):
            raw = t.encode()
            words = raw.split()
            ps = sorted((p["low"], p["high"], p["times"]) for p in ps)
            passes = []
            for turn in range(max(p[2] for p in ps)):
                some = [p for p in ps if p[2] > turn]
                if sum(p[1] - p[0] for p in some) == len(words):
                    passes.append(raw)
                else:
                    passes.append(b" ".join(w for low, high, _ in some for w in words[low:high]))
            out.append(b"\n".join(passes).decode())
        return pd.Series(out)

    new = units.join(parts.hint("merge"), "_unit").select("_row", cut(F.col(f"_row.{text}"), F.col("_parts")).alias("_text"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("_text").alias(c))
        elif c == "n_chars":
            out.append(F.length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"_row.`{c}`").alias(c))
    return new.select(*out)
