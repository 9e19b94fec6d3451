"""Raw session events as a stream of files become the records that the batch plan gives.

A watermarked stream-stream interval join brings each compaction together with the events of its seq range.
Both sides are cut into slices of sequence numbers, so a busy session is dealt over many state partitions.
Every micro-batch writes what it joined to its own part of a staging table, computes the records of the
compactions that it touched from all that is staged for them, and writes those to its own part of the record
table. A reader takes the newest version of each compaction. So:

* a replayed micro-batch overwrites its own parts with the same rows;
* events that come late, within the watermark's delay, give the compaction a new version;
* lines delivered twice count once: staged rows are taken once per (session, compaction, seq).

``delay`` is how late an event may come, ``horizon`` how much older than its compaction an event may be and
still be held as state. Older ones are looked up in ``archive``, a table of past raw events, if one is given.
Work of a micro-batch follows the days whose compactions it touches, never the whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.records import RECORD_COLUMNS, first_occurrences
from palimpsest.operators.turns import RANGE_SLICE, in_ranges
from palimpsest.plans.events import COMPACTION_COLUMNS, EVENT_COLUMNS, dispatch
from palimpsest.plans.ingest import ORDER, finished, ingest_rows, numbered
from palimpsest.settings import Settings
from palimpsest.sources.session_log import parse_events

DELAY = "1 day"
HORIZON = "30 days"
KEYS = ["session", "compaction_id"]


def line_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of the plain session logs under ``root`` (any depth) as they arrive."""
    return (
        spark.readStream.option("maxFilesPerTrigger", str(files_per_batch)).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "session*.jsonl").text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    )


def slices(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / RANGE_SLICE), F.floor(high / RANGE_SLICE))


def joined(raw: DataFrame, settings: Settings = Settings(), delay: str = DELAY, horizon: str = HORIZON) -> DataFrame:
    """``is_event``, the compaction's facts as struct ``c`` and the event as struct ``e`` (null for the
    compaction's own row), from a stream of raw events."""
    time = F.coalesce(F.timestamp_millis("time_ms"), F.current_timestamp())
    timed = raw.withColumn("time", time).withWatermark("time", delay)
    routed = dispatch(timed, settings, keep=("time",))
    facts = F.struct(*COMPACTION_COLUMNS).alias("c")
    own = routed.compactions.select(F.lit(False).alias("is_event"), facts, F.lit(None).cast(_event_type(routed.events)).alias("e"))
    valid = (F.col("seq_start") >= 0) & (F.col("seq_end") >= F.col("seq_start"))
    ranges = routed.compactions.where(valid).select(
        F.col("session").alias("c_session"), F.explode(slices(F.col("seq_start"), F.col("seq_end"))).alias("c_slice"),
        F.col("time").alias("c_time"), facts,
    )
    events = routed.events.select(
        F.col("session").alias("e_session"), F.floor(F.col("seq") / RANGE_SLICE).alias("e_slice"), F.col("time").alias("e_time"),
        F.struct(*EVENT_COLUMNS).alias("e"),
    )
    near = (F.col("e_time") >= F.col("c_time") - F.expr(f"INTERVAL {horizon}")) & (
        F.col("e_time") <= F.col("c_time") + F.expr(f"INTERVAL {delay}")
    )
    within = (F.col("e.seq") >= F.col("c.seq_start")) & (F.col("e.seq") <= F.col("c.seq_end"))
    same = (F.col("e_session") == F.col("c_session")) & (F.col("e_slice") == F.col("c_slice"))
    pairs = events.join(ranges, same & within & near).select(F.lit(True).alias("is_event"), "c", "e")
    return own.unionByName(pairs)


def _event_type(events: DataFrame) -> str:
    return events.select(F.struct(*EVENT_COLUMNS).alias("e")).schema["e"].dataType.simpleString()


class EventIngest:
    """The tables of one ingest under ``root``: ``staged`` and ``records``, both by day and batch."""

    def __init__(
        self, spark: SparkSession, root: str, settings: Settings = Settings(), archive: DataFrame | None = None,
        delay: str = DELAY, horizon: str = HORIZON,
    ):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.archive, self.delay, self.horizon = archive, delay, horizon

    def start(self, lines: DataFrame, checkpoint: str) -> StreamingQuery:
        """Ingest what has arrived and stop; started again with ``checkpoint`` it goes on from there."""
        stream = joined(parse_events(lines), self.settings, self.delay, self.horizon)
        return (
            stream.writeStream.foreachBatch(self.write).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        """Replace this batch's part of a table."""
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch").parquet(f"{self.root}/{name}")

    def write(self, rows: DataFrame, batch: int) -> None:
        day = F.to_date(F.timestamp_millis(F.coalesce("c.time_ms", F.lit(0))))
        self._put(rows.withColumn("day", day), "staged", batch)
        # the days of a batch are few: they lie within the delay, or a backlog's calendar
        mine = self.spark.read.parquet(f"{self.root}/staged").where(F.col("batch") == batch)
        days = [r["day"] for r in mine.select("day").distinct().collect()]
        if not days:
            return
        paths = [f"{self.root}/staged/day={d}" for d in days]
        staged = self.spark.read.option("basePath", f"{self.root}/staged").parquet(*paths).where(F.col("batch") <= batch)
        touched = mine.select("day", "c.session", "c.compaction_id").distinct()
        kept = (
            staged.withColumns({k: F.col("c")[k] for k in KEYS})
            .join(touched, ["day", *KEYS], "left_semi")
        )
        compactions = (
            kept.where(~F.col("is_event")).dropDuplicates(["day", *KEYS]).select("day", "c.*")
        )
        inside = kept.where("is_event").select(*KEYS, F.struct("e.*").alias("e")).select("compaction_id", "e.*")
        if self.archive is not None:
            old = F.timestamp_millis("time_ms") < F.timestamp_millis("c_time_ms") - F.expr(f"INTERVAL {self.horizon}")
            ranges = compactions.select(*KEYS, "seq_start", "seq_end", F.col("time_ms").alias("c_time_ms"))
            past = in_ranges(dispatch(self.archive, self.settings, keep=("time_ms",)).events, ranges).where(old)
            inside = inside.unionByName(past.select("compaction_id", *EVENT_COLUMNS))
        inside = inside.dropDuplicates([*KEYS, "seq"])
        made = finished(ingest_rows(inside, compactions.drop("day"), self.settings))
        # a compaction without a block still has this version
        self._put(
            compactions.select("day", *KEYS).join(made.select(*RECORD_COLUMNS, *ORDER[1:]), KEYS, "left"), "records", batch
        )

    def versions(self) -> DataFrame:
        """All stored versions of all compactions."""
        return self.spark.read.parquet(f"{self.root}/records")

    def records(self) -> DataFrame:
        """The newest version of each compaction as records; of equal blocks of a session the first stays."""
        every = self.versions()
        newest = every.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
        rows = every.join(newest, [*KEYS, "batch"]).where("text is not null").drop("ord")
        return first_occurrences(numbered(rows)).select(*RECORD_COLUMNS)
