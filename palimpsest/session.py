"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
TASK_BYTES = 4 << 20
BROADCAST_ROWS = 100_000
PACKED_ROWS, PACKED_BYTES = 1 << 19, 32 << 20


def local_session(app: str = "palimpsest", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="palimpsest-ckpt-")
    sc.setCheckpointDir(shared)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy.

    Used where a later step must see exactly the same partitions twice, so a lost executor
    cannot change the answer between the two reads.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove at once what no one holds any more: a finished step's shuffle files stay on the executors'
    disks until the driver collects the plans that made them."""
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for tables that only this application reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: readers take only the columns they need,
    and the planner knows its size."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offered(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` settled, and marked for broadcast if it has at most ``rows`` rows, so that a large table it is
    joined with stays where it lies."""
    side = settle(side)
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def text_parts(df: DataFrame, text: str = "text") -> int:
    """How many partitions keep a task's share of ``text`` near ``TASK_BYTES``; one slim pass counts the bytes.

    Never fewer than the session's shuffle width.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(width, math.ceil(total / TASK_BYTES))


def spread(df: DataFrame, *cols: str, parts: int | None = None) -> DataFrame:
    """Hash rows by ``cols`` into ``parts`` partitions, the session's full shuffle width unless given.

    An explicit count keeps the width: adaptive execution would merge these partitions by bytes,
    while text work on them is bound by CPU.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *cols)


def dealt(rows: DataFrame, parts: int, *cols: str) -> DataFrame:
    """``rows`` in ``parts`` partitions, the ones that a table bucketed by ``cols`` puts them into.

    Rows are shuffled sorted and compressed, many at a time and columns apart, which takes a fraction of their bytes
    one by one. A task holds at most ``PACKED_ROWS`` rows and about ``PACKED_BYTES`` of them.
    """
    schema, names = rows.schema, rows.columns

    def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("_to", *cols)]).combine_chunks()
        to = table.column("_to").to_numpy()
        ends = [*(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
        found = []
        for low, high in zip([0, *ends], ends):
            piece = table.slice(low, high - low).select(names)
            columns = [c.combine_chunks().dictionary_encode() if pa.types.is_string(c.type) else c for c in piece.columns]
            sink = pa.BufferOutputStream()
            piece = pa.Table.from_arrays(columns, names)
            with pa.ipc.new_stream(sink, piece.schema) as out:
                out.write_table(piece)
            data = sink.getvalue()
            found.append((to[low], data.size, pa.compress(data, codec="zstd", asbytes=True)))
        to, sizes, packed = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["_to", "_size", "_rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count, size = count + batch.num_rows, size + batch.nbytes
            if count >= PACKED_ROWS or size >= PACKED_BYTES:
                yield blobs(held)
                held, count, size = [], 0, 0
        if held:
            yield blobs(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, packed in zip(batch.column("_size").to_pylist(), batch.column("_rows")):
                table = pa.ipc.open_stream(pa.decompress(packed.as_buffer(), size, codec="zstd")).read_all()
                kinds = [c.type.value_type if pa.types.is_dictionary(c.type) else c.type for c in table.columns]
                yield from table.cast(pa.schema(zip(names, kinds))).to_batches()

    packed = rows.withColumn("_to", F.expr(f"pmod(hash({', '.join(cols)}), {parts})")).mapInArrow(pack, "_to int, _size bigint, _rows binary")
    return packed.repartitionById(parts, "_to").mapInArrow(unpack, schema)
