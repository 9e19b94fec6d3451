"""The parquet tables read as the entities of the record model.

documents -> blocks (source = session, doc_id = order), benchmark -> questions,
conversations -> session events (turn = seq), labels -> verdicts, events -> activity log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.records import finish_records
from palimpsest.session import text_parts

GROUP_BLOCKS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_of(doc_id: Column) -> Column:
    return F.floor(doc_id / GROUP_BLOCKS)


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks: short ones are summaries, the others raw text.

    Every run of 200 document ids shares one compaction and one timestamp.
    """
    group = group_of(F.col("doc_id"))
    at = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + group * 3600), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("session"),
        F.col("doc_id").alias("ord"),
        F.when(F.length("text") < 900, "summary").otherwise("raw").alias("layer"),
        F.concat_ws("-", "source", group.cast("string")).alias("compaction_id"),
        at.alias("at"),
        F.lit(None).cast("int").alias("turn"),
        (group * GROUP_BLOCKS).alias("seq_start"),
        (group * GROUP_BLOCKS + GROUP_BLOCKS - 1).alias("seq_end"),
        F.lit(None).cast("bigint").alias("shadowed_tokens"),
        "text",
        F.lit(None).cast("string").alias("src"),
        F.lit(None).cast("string").alias("tool"),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = document_blocks(spark, sf_dir)
    return finish_records(blocks, parts=text_parts(blocks))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each asked in one session that its number chooses."""
    session = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), session.alias("session"), "text")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as session events; system rows are injected, not asked by a person."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"),
        (F.col("turn") + 1).alias("seq"),
        F.when(role == "assistant", "assistant/message").otherwise("user/message").alias("type"),
        F.when(role == "system", "system").otherwise("user").alias("kind"),
        F.col("text"),
    )
