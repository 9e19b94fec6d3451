"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, mixing, near_dup, token_store, toxicity
from palimpsest.llm.common import table, written


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, and that column's name; written, so it never changes."""
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    labels = toxicity.label_categories(table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    scored = toxicity.scored(rows, labels, toxicity.CATEGORIES, "toxic")
    return scored.where(~F.col("rejected")).select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the lowest doc_id of each near-duplicate group; of repeated rows one stays."""
    keyed, key = _keyed(docs)
    found = near_dup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    names = keyed.select(F.col(key).alias("_k"), F.col("doc_id").alias("_doc"), F.sha2("text", 256).alias("_text"))
    rows = found.select(F.col("doc_id").alias("_k"), "component_id", "n_shingles").join(names, "_k")
    # texts without a word are alone in their groups: of them only repeated rows go
    empty = F.col("n_shingles") == 0
    group = [F.when(~empty, F.col("component_id")), F.when(empty, F.col("_doc")), F.when(empty, F.col("_text"))]
    first = F.min(F.struct(F.col("_doc").isNull(), "_doc", "_text", "_k"))["_k"]
    kept = rows.groupBy(empty, *group).agg(first.alias(key)).select(key)
    return keyed.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed, key = _keyed(docs)
    items = decontaminate.item_parts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    gone = decontaminate.leaks(keyed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as token ids and return what the store gives back."""
    return token_store.stored_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source mix", mixing_stage),
    ("token ids", token_stage),
]

#: No single SQL statement expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
