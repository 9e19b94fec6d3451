"""The record store: Parquet partitioned by session, with trash, logs and JSON lines exchange."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.mutations import restorable, split_deleted, unseen_records
from palimpsest.session import settle

RECORD_SCHEMA = (
    "session string, ord bigint, layer string, compaction_id string, at string, turn int, "
    "seq_start bigint, seq_end bigint, shadowed_tokens bigint, title string, "
    "keywords array<string>, text string, fp string, src string, tool string"
)
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)
REDO = 4


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records exchanged as JSON lines; broken lines and lines without text are dropped."""
    return spark.read.schema(RECORD_SCHEMA).json(path).where("text is not null")


class BlockStore:
    """Tables under one folder. Changes rewrite only the sessions they touch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._lock = _LOCKS[self.root]

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as exc:  # noqa: BLE001 - only a missing folder is an empty table
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        return self._read("records", RECORD_SCHEMA)

    def trash(self) -> DataFrame:
        return self._read("trash", RECORD_SCHEMA + ", trash_id string, deleted_at timestamp")

    def _append(self, rows: DataFrame, name: str, by: str) -> None:
        rows.write.mode("append").partitionBy(by).parquet(f"{self.root}/{name}")

    def append(self, fresh: DataFrame) -> int:
        """Add records whose fingerprint the session does not hold; returns how many."""
        with self._lock:
            rows = settle(unseen_records(fresh, self.records()))
            count = rows.count()
            if count:
                self._append(rows.select(*self.records().columns), "records", "session")
            return count

    def _version(self) -> frozenset[str]:
        return frozenset(self.records().inputFiles())

    def rewrite(self, mutate: Callable[[DataFrame], DataFrame], sessions: DataFrame) -> int:
        """Replace the records of ``sessions`` by ``mutate`` of them.

        The new rows are settled before the old files go. When the files changed meanwhile the
        change is computed again on the new content.
        """
        with self._lock:
            for attempt in range(REDO + 1):
                seen = self._version()
                touched = self.records().join(sessions.distinct(), "session", "left_semi")
                rows = settle(mutate(touched).select(*self.records().columns))
                if self._version() == seen or attempt == REDO:
                    break
            before = settle(touched.select("session").distinct())
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "session"
            ).parquet(f"{self.root}/records")
            self._drop_empty(before.join(rows.select("session").distinct(), "session", "left_anti"))
            return rows.count()

    def _drop_empty(self, emptied: DataFrame) -> None:
        """Remove the partitions of sessions that lost their last record."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for row in emptied.toLocalIterator():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/records/session={row.session}")
            path.getFileSystem(conf).delete(path, True)

    def delete(self, chosen: DataFrame, trash_id: str, *, keep_trash: bool = True) -> int:
        """Delete the chosen ``session, fp``; victims go to the trash first."""
        with self._lock:
            _, victims = split_deleted(self.records(), chosen)
            victims = settle(victims)
            count = victims.count()
            if count == 0:
                return 0
            if keep_trash:
                self._append(
                    victims.withColumn("trash_id", F.lit(trash_id)).withColumn(
                        "deleted_at", F.current_timestamp()
                    ).select(*self.trash().columns),
                    "trash", "trash_id",
                )
            self.rewrite(lambda rows: split_deleted(rows, chosen)[0], victims.select("session"))
            return count

    def restore(self, trash_id: str) -> int:
        """Bring a trash entry back, skipping blocks the store already has."""
        with self._lock:
            entry = self.trash().where(F.col("trash_id") == trash_id)
            rows = settle(restorable(entry, self.records()))
            count = rows.count()
            if count:
                self._append(rows.select(*self.records().columns), "records", "session")
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/trash/trash_id={trash_id}")
            path.getFileSystem(conf).delete(path, True)
            return count

    def log(self, name: str, rows: DataFrame) -> None:
        """Append to an audit, verdict or diagnostics log."""
        rows.withColumn("at", F.current_timestamp()).write.mode("append").json(
            f"{self.root}/_{name}"
        )
