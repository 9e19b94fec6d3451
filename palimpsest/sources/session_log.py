"""Session logs: multi-frame zstd or plain JSON lines, one event per line."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import vocab as V

_MAGIC = 0xFD2FB528
_LINES = "path string, frames int, failed int, torn boolean, line_no bigint, line string"


class BrokenFrame(ValueError):
    """The bytes are not a sequence of zstd frames."""


def frame_spans(data: bytes) -> tuple[list[tuple[int, int]], int | None]:
    """(start, end) of every whole frame, and where a torn last frame starts, if any.

    Follows the public zstd frame layout: header fields give the header's size, then each block
    header gives the size of the block that follows.
    """
    spans: list[tuple[int, int]] = []
    start = 0
    while start < len(data):
        end = _frame_end(data, start)
        if end is None:
            return spans, start
        spans.append((start, end))
        start = end
    return spans, None


def _frame_end(data: bytes, start: int) -> int | None:
    if len(data) - start < 5:
        if len(data) - start >= 4 and struct.unpack_from("<I", data, start)[0] != _MAGIC:
            raise BrokenFrame(f"bad magic at {start}")
        return None
    if struct.unpack_from("<I", data, start)[0] != _MAGIC:
        raise BrokenFrame(f"bad magic at {start}")
    flags = data[start + 4]
    if flags & 0x18:
        raise BrokenFrame(f"reserved header bits at {start + 4}")
    single, size_code = bool(flags & 0x20), flags >> 6
    size_field = (1 << size_code) if size_code else int(single)
    at = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_field
    last = False
    while not last:
        if len(data) < at + 3:
            return None
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), (head >> 1) & 3, head >> 3
        if kind == 3:
            raise BrokenFrame(f"reserved block type at {at}")
        at += 3 + (1 if kind == 1 else size)
        if len(data) < at:
            return None
    at += 4 if flags & 4 else 0
    return at if at <= len(data) else None


def _lines_of(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    for batch in files:
        for path, data in zip(batch["path"], batch["content"]):
            failed, torn, parts = 0, False, [data]
            spans: list[tuple[int, int]] = []
            if path.endswith(".zstd"):
                parts = []
                try:
                    spans, torn_at = frame_spans(data)
                    torn = torn_at is not None
                except BrokenFrame:
                    failed = 1
                for a, b in spans:
                    try:
                        parts.append(zstandard.ZstdDecompressor().decompressobj().decompress(data[a:b]))
                    except zstandard.ZstdError:
                        failed += 1
            lines = b"".join(parts).decode("utf-8", "replace").split("\n")
            rows = [(i, x) for i, x in enumerate(lines) if x.strip()]
            yield pd.DataFrame({
                "path": path, "frames": len(spans), "failed": failed, "torn": torn,
                "line_no": [r[0] for r in rows], "line": [r[1] for r in rows],
            })


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """``session, project, path, bytes, modified`` of every log under ``root``.

    Layout: root/<project>/<session>/session[.vN].jsonl[.zstd]. Contents are not read.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "session*").load(root)
        .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    )
    parts = F.split("path", "/")
    return found.where(F.col("path").rlike("/" + V.LOG_NAME)).select(
        F.element_at(parts, -2).alias("session"), F.element_at(parts, -3).alias("project"),
        "path", "bytes", "modified",
    )


def best_logs(files: DataFrame) -> DataFrame:
    """One log per session: compressed before plain, then the highest path."""
    return files.groupBy("session").agg(
        F.max_by(F.struct("project", "path", "bytes", "modified"),
                 F.struct(F.col("path").endswith(".zstd"), "path")).alias("b")
    ).select("session", "b.*")


def find_log(files: DataFrame, wanted: str) -> DataFrame:
    """The log of a session id: exact name, else a prefix that only one folder has."""
    named = files.where(F.startswith("session", F.lit(wanted))).withColumn(
        "_exact", F.col("session") == wanted
    )
    marks = named.agg(
        F.bool_or("_exact").alias("any"), F.count_distinct("project", "session").alias("folders")
    ).first()
    if marks["any"]:
        chosen = named.where("_exact")
    else:
        chosen = named if marks["folders"] == 1 else named.limit(0)
    order = [F.desc(F.col("path").endswith(".zstd")), F.desc("path")]
    return chosen.orderBy(*order).limit(1).select(*files.columns)


def within_gate(files: DataFrame, limit: int) -> DataFrame:
    """Logs up to a size, for callers that want a gate; a missing size is allowed."""
    return files.where(F.col("bytes").isNull() | (F.col("bytes") <= limit))


def read_lines(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Decoded lines of the one log of each session under ``root``; a broken frame is counted and skipped.

    No log is left out for its size unless the caller sets ``limit``.
    """
    chosen = best_logs(log_files(spark, root)).select("path")
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "session*").load(root)
        .where(F.col("path").rlike("/" + V.LOG_NAME))
    )
    if limit is not None:
        found = found.where(F.col("length") <= limit)
    return found.join(chosen, "path", "left_semi").select("path", "content").mapInPandas(_lines_of, _LINES)


def parse_events(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects with a string ``type``; others are dropped."""
    value = F.try_parse_json("line")
    typed = lines.withColumn("_v", value).where(
        F.schema_of_variant(F.try_variant_get("_v", "$.type", "variant")) == "STRING"
    )
    def get(path: str, kind: str):
        return F.try_variant_get("_v", path, kind)

    return typed.select(
        "path", "line_no",
        F.element_at(F.split("path", "/"), -2).alias("session"),
        get("$.type", "string").alias("type"), get("$.seq", "bigint").alias("seq"),
        get("$.time", "bigint").alias("time_ms"), get("$.cwd", "string").alias("cwd"),
        get("$.data.source.kind", "string").alias("kind"),
        get("$.data.source.form", "string").alias("form"),
        get("$.data.source.rpcId", "string").alias("rpc_id"),
        F.coalesce(get("$.data.turn", "int"), get("$.turn", "int")).alias("turn"),
        F.coalesce(get("$.data.callId", "string"), get("$.data.message.toolCallId", "string"),
                   get("$.data.message.source.callId", "string")).alias("call_id"),
        get("$.data.name", "string").alias("name"),
        get("$.data.arguments", "string").alias("args"),
        F.coalesce(get("$.data.message.isError", "boolean"), F.lit(False)).alias("is_error"),
        get("$.data.message.id", "string").alias("message_id"),
        get("$.data.compactionId", "string").alias("compaction_id"),
        get("$.data.shadowedRange.start", "bigint").alias("seq_start"),
        get("$.data.shadowedRange.end", "bigint").alias("seq_end"),
        get("$.data.shadowedTokenCount", "bigint").alias("shadowed_tokens"),
        F.coalesce(
            F.from_json(F.coalesce(
                get("$.data.content", "string"), get("$.data.message.content", "string"),
                get("$.data.summary", "string")), "array<struct<type:string,text:string>>"),
        ).alias("blocks"),
    )
