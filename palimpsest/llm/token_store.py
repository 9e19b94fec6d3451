"""Token ids as binary shards with a minimal perfect hash index.

Layout of a store (a folder that Spark can write and read):

* ``shards/``: one row per shard, shards in ascending key order: ``shard``, ``payload`` (raw little-endian
  ids, two bytes each where the vocabulary allows it), ``base`` (ids of the same range before the shard),
  and the directory of its documents: ``keys``, ``lengths`` in payload order.
* ``index/``: one row per hash bucket of document keys. A bucket is a minimal perfect hash: ``seeds`` holds a
  displacement for each group of keys, and key -> slot hits each of the bucket's n slots once. The slot
  arrays hold a 32-bit fingerprint and the place: ``shard``, ``start`` (position in the payload), ``count``.

A lookup hashes the key, reads one displacement, one slot, compares the fingerprint, and has the place in
constant time. Ranges of keys are dealt to tasks by cut points, ids stream through a task in key order, and
no task holds more than one open shard.

Defined results: a null text is empty and yields only the end id; a null key sorts first; repeated keys are
told apart by their occurrence number (rows of one key in the order of their ids); a document larger than a
shard gets a shard of its own; an empty table gives an empty store.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.chunked import chunk_ids
from palimpsest.llm.common import order_bounds, order_part, order_parts, scratch_path, shuffle_width

TOKENIZER = "byte_bpe_50k.json"
SHARD_BYTES = 4 << 20
BUCKET_KEYS = 2000
GROUP_KEYS = 4
RANGE_SHARDS = 1 << 32

SHARD_SCHEMA = (
    "part long, shard long, base long, width int, payload binary, keys array<long>, lengths array<int>"
)
INDEX_SCHEMA = (
    "bucket long, seeds array<int>, prints array<long>, shards array<long>, starts array<long>, counts array<int>"
)


def encoded(rows: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(part, key, ids) of rows (part, key, text): ids of the whole text and the end id, as packed bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = chunk_ids(tokenizer).encode(batch.column("text").to_pylist(), end)
            columns = [batch.column("part"), batch.column("key"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "ids"])

    return rows.mapInArrow(of, "part long, key long, ids binary")


def id_width(tokenizer: str) -> int:
    return np.dtype(chunk_ids(tokenizer).dtype).itemsize


def write_shards(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
    end: int = 0, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode every row of ``docs`` and write the ids in ascending key order."""
    spark = docs.sparkSession
    width = id_width(tokenizer)
    bounds = order_bounds(docs, key, order_parts(spark))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, base, held, ids, keys, lengths = None, 0, 0, 0, [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame({
                "part": [part], "shard": [part * RANGE_SHARDS + shard], "base": [base], "width": [width],
                "payload": [b"".join(ids)], "keys": [list(keys)], "lengths": [list(lengths)],
            })

        for batch in batches:
            for p, k, raw in zip(batch["part"].tolist(), batch["key"].tolist(), batch["ids"]):
                if ids and (p != part or held + len(raw) > shard_bytes):
                    yield row()
                    shard, base = shard + 1, base + held // width
                    held, ids, keys, lengths = 0, [], [], []
                if p != part:
                    part, shard, base = p, 0, 0
                ids.append(raw)
                keys.append(None if pd.isna(k) else int(k))
                lengths.append(len(raw) // width)
                held += len(raw)
        if ids:
            yield row()

    rows = docs.select(
        order_part(key, bounds).cast("long").alias("part"), F.col(key).cast("long").alias("key"),
        F.col(text).cast("string").alias("text"),
    )
    (
        encoded(rows, tokenizer, end)
        .repartition(shuffle_width(spark), "part")
        .sortWithinPartitions("part", "key", "ids")
        .mapInPandas(pack, SHARD_SCHEMA)
        .write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/shards")
    )


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document from the shards' directories: key, occurrence, shard, start, count."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "keys", "lengths")
    def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, keys, lengths in zip(batch["shard"], batch["keys"], batch["lengths"]):
                n = np.asarray(lengths, np.int64)
                yield pd.DataFrame({
                    "key": pd.array([None if pd.isna(k) else int(k) for k in keys], dtype="Int64"),
                    "shard": np.int64(shard), "start": np.cumsum(n) - n, "count": n.astype(np.int32),
                })

    rows = shards.mapInPandas(unfold, "key long, shard long, start long, count int")
    nth = Window.partitionBy("key").orderBy("shard", "start")
    return rows.withColumn("occurrence", F.row_number().over(nth) - 1)


def _mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each key group, slot of each key) so that the slots are a permutation."""
    n = len(h)
    groups = max(1, math.ceil(n / GROUP_KEYS))
    group = (_mix(h, 0) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, slots, taken = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for g in np.argsort(np.diff(cuts) * -1, kind="stable"):
        members = order[cuts[g] : cuts[g + 1]]
        if not len(members):
            break
        for lo in range(1, 1 << 30, 64):
            tries = np.arange(lo, lo + 64, dtype=np.uint64)
            at = (_mix(h[members][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            ok = ~taken[at].any(axis=1)
            if len(members) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(np.argmax(ok))
                seeds[g], slots[members] = lo + i, at[i]
                taken[at[i]] = True
                break
    return seeds, slots


def find_slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    group = (_mix(h, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (_mix(h, seeds[group]) % np.uint64(n)).astype(np.int64)


def hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the two 64-bit hashes of (key, occurrence) and the bucket."""
    return rows.withColumns({
        "h": F.xxhash64(F.lit(1), F.coalesce("key", F.lit(0)), F.col("key").isNull(), F.col("occurrence").cast("long")),
        "check": F.pmod(
            F.xxhash64(F.lit(2), F.coalesce("key", F.lit(0)), F.col("key").isNull(), F.col("occurrence").cast("long")),
            F.lit(1 << 32),
        ),
    }).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))


def write_index(spark: SparkSession, path: str, bucket_keys: int = BUCKET_KEYS) -> int:
    """Build the index of a store from its shards' directories; returns the number of buckets."""
    total = spark.read.parquet(f"{path}/shards").agg(F.sum(F.size("lengths"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys share both hashes; use another first hash")
        seeds, slots = build_hash(h)
        at = np.argsort(slots)
        return pd.DataFrame({
            "bucket": [int(rows["bucket"].iloc[0])], "seeds": [seeds], "prints": [rows["check"].to_numpy()[at]],
            "shards": [rows["shard"].to_numpy()[at]], "starts": [rows["start"].to_numpy()[at]],
            "counts": [rows["count"].to_numpy()[at]],
        })

    (
        hashed(directory(spark, path), buckets)
        .select("bucket", "h", "check", "shard", "start", "count")
        .groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    )
    return buckets


def lookup(spark: SparkSession, path: str, keys: DataFrame, buckets: int) -> DataFrame:
    """Places of ``keys`` (key, occurrence) by the index; keys that are not stored give no row."""

    def probe(wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "occurrence": [], "shard": [], "start": [], "count": []}
        if len(wanted) and len(index):
            one = index.iloc[0]
            slots = find_slots(wanted["h"].to_numpy(np.int64).view(np.uint64), np.asarray(one["seeds"]), len(one["prints"]))
            hit = np.asarray(one["prints"])[slots] == wanted["check"].to_numpy()
            slots, wanted = slots[hit], wanted[hit]
            out = {
                "key": wanted["key"].astype("Int64"), "occurrence": wanted["occurrence"],
                "shard": np.asarray(one["shards"])[slots], "start": np.asarray(one["starts"])[slots],
                "count": np.asarray(one["counts"])[slots],
            }
        return pd.DataFrame(out)

    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")
    return (
        hashed(keys.select(F.col("key").cast("long").alias("key"), F.col("occurrence").cast("int").alias("occurrence")), buckets)
        .groupBy("bucket").cogroup(index.groupBy("bucket"))
        .applyInPandas(probe, "key long, occurrence int, shard long, start long, count int")
    )


def read_places(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read the payloads back: for each place of each shard its global start, checksum and, if wanted, ids."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, shard, base, width, raw, lengths in zip(
                *(batch[c] for c in ("part", "shard", "base", "width", "payload", "lengths"))
            ):
                n = np.asarray(lengths, np.int64)
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                starts = np.cumsum(n) - n
                cut = [ids[a : a + k] for a, k in zip(starts, n)]
                out = {
                    "part": part, "shard": shard, "start": starts, "local": base + starts,
                    "crc": [zlib.crc32(c.tobytes()) for c in cut],
                }
                if with_ids:
                    out["ids"] = [c.astype(np.int64) for c in cut]
                yield pd.DataFrame(out)

    schema = "part long, shard long, start long, local long, crc long" + (", ids array<long>" if with_ids else "")
    places = shards.select("part", "shard", "base", "width", "payload", "lengths").mapInPandas(read, schema)
    return places.join(offsets, "part").withColumn("first", F.col("local") + F.col("offset")).drop("part", "local", "offset")


def write_store(docs: DataFrame, path: str, **how) -> int:
    write_shards(docs, path, **how)
    return write_index(docs.sparkSession, path)


def fetch(spark: SparkSession, path: str, keys: DataFrame, buckets: int) -> DataFrame:
    """(key, occurrence, ids) of the wanted keys through the index; reads only the shards that hold them."""
    places = lookup(spark, path, keys, buckets)
    return places.join(read_places(spark, path, with_ids=True), ["shard", "start"]).select("key", "occurrence", "ids")


def stored_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", **how) -> DataFrame:
    """Write a store of ``docs``, look every key up in its index, and read the ids back from the shards.

    One row per row of ``docs``: the key, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    buckets = write_store(docs, path, key=key, **how)
    keys = (
        docs.groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        .select("key", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("occurrence"))
    )
    return (
        lookup(spark, path, keys, buckets)
        .join(read_places(spark, path), ["shard", "start"])
        .select(
            F.col("key").alias(key), F.col("first").alias("start"), F.col("count").cast("long").alias("n_tokens"),
            F.col("crc").alias("ids_crc32"),
        )
    )
