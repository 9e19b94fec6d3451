"""What lies in a workspace: session files, the newest log of each session, all records, known workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ordered import exact_rank
from palimpsest.sources.store import RECORD_SCHEMA


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """``session, path, bytes, modified`` of the session files directly under ``root``, contents unread.

    Files whose name begins with an underscore are the store's own ledgers; empty files, which hold no block, are
    passed over by Spark.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~F.startswith(name, F.lit("_"))).select(
        F.substring(name, F.lit(1), F.length(name) - len(".jsonl")).alias("session"), "path",
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def newest_logs(files: DataFrame) -> DataFrame:
    """One row of ``log_files`` per session: the last modified; of equally old ones the highest path."""
    rest = [c for c in files.columns if c != "session"]
    return files.groupBy("session").agg(
        F.max_by(F.struct(*rest), F.struct("modified", "path")).alias("f")
    ).select("session", "f.*")


def workspace_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of all session files of a workspace, with ``file``. A line that is no record is left out, and a file
    that cannot be read (a torn archive, say) loses only itself."""
    read = spark.read.schema(RECORD_SCHEMA).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true")
    rows = read.option("pathGlobFilter", "[!_]*.jsonl*").json(root)
    return rows.where("text is not null").withColumn("file", F.col("_metadata.file_path"))


def known_workspaces(lists: list[DataFrame]) -> DataFrame:
    """``workspace, place``: the names of ``lists`` (workspace, pos), the first list first, each name where it stands
    first; null and empty names are left out. Numbered from 0 by a range shuffle, whatever their number."""
    whole = None
    for rank, names in enumerate(lists):
        rows = names.where("workspace is not null and workspace <> ''").select("workspace", F.lit(rank).alias("rank"), "pos")
        whole = rows if whole is None else whole.unionByName(rows)
    first = whole.groupBy("workspace").agg(F.min(F.struct("rank", "pos")).alias("at"))
    keyed = first.select(F.lit(0).alias("_all"), "workspace", "at")
    placed = exact_rank(keyed, ["_all"], [F.col("at.rank"), F.col("at.pos"), F.col("workspace")], "place")
    return placed.select("workspace", F.col("place").cast("bigint").alias("place"))
