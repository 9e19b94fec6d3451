"""Fielded term statistics: postings, block lengths, document frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.functions.counting import token_counts
from palimpsest.operators.records import first_occurrences, first_ords
from palimpsest.session import offered, settle, stored, text_parts


@dataclass(frozen=True)
class BlockIndex:
    """Tables of one index; every statistic is kept per session.

    postings: session, ord, layer, token, tf, len      blocks: session, ord, layer, fp, at, …
    terms: session, token, df                          corpus: session, n, avgdl
    records: what it was built from, if it is not stored yet
    counted: whether ``terms`` is a table already, not yet to be counted from the postings
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    records: DataFrame | None = None
    counted: bool = False

    def terms_of(self, asked: DataFrame) -> DataFrame:
        """Rows of ``terms`` for the tokens of ``asked`` (token[, session]); no other token is counted."""
        on = ["session", "token"] if "session" in asked.columns else ["token"]
        wanted = offered(asked.select(*on).distinct())
        if self.counted:
            return self.terms.join(wanted, on, "left_semi")
        return term_stats(self.postings.join(wanted, on, "left_semi"))

    def settled(self) -> BlockIndex:
        """Write postings and block statistics once; the small tables derive from them."""
        postings = stored(self.postings, "postings")
        return assemble(postings, settle(self._blocks(postings)))

    def _blocks(self, postings: DataFrame) -> DataFrame:
        """Block statistics from written postings, so that no text is tokenized twice."""
        return self.blocks if self.records is None else stats_from(self.records, postings)

    def write(self, path: str) -> None:
        """Store the index; postings are clustered by token so scans can skip row groups."""
        self.postings.repartitionByRange("token", "session", "ord").sortWithinPartitions(
            "token", "session"
        ).write.mode("overwrite").parquet(f"{path}/postings")
        stored = self.postings.sparkSession.read.parquet(f"{path}/postings")
        self._blocks(stored).write.mode("overwrite").parquet(f"{path}/blocks")
        term_stats(stored).write.mode("overwrite").parquet(f"{path}/terms")
        blocks = self.postings.sparkSession.read.parquet(f"{path}/blocks")
        corpus_stats(blocks).write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    return BlockIndex(load("postings"), load("blocks"), load("terms"), load("corpus"), counted=True)


def with_field_tokens(records: DataFrame) -> DataFrame:
    return records.withColumns({
        "_title": K.tokens(F.col("title")),
        "_words": K.tokens(F.array_join("keywords", " ")),
        "_text": K.tokens(F.col("text")),
    })


def _length() -> Column:
    weights = {"_title": V.WEIGHT_TITLE, "_words": V.WEIGHT_KEYWORDS, "_text": V.WEIGHT_TEXT}
    return sum((F.size(c) * w for c, w in weights.items()), start=F.lit(0)).cast("double")


BLOCK_FACTS = ["session", "ord", "layer", "fp", "at", "title", "compaction_id", "seq_end", "src", "tool"]


def block_stats(records: DataFrame) -> DataFrame:
    return with_field_tokens(records).select(
        *BLOCK_FACTS,
        _length().alias("len"),
        F.size(F.array_distinct(F.concat("_title", "_words", "_text"))).alias("terms"),
        K.conclusion_score(F.col("text")).alias("concl"),
        K.is_blank(F.col("text")).alias("blank"),
    )


def stats_from(records: DataFrame, postings: DataFrame) -> DataFrame:
    """``block_stats`` of the first occurrences in ``records`` whose postings are there already; texts stay where they are."""
    counted = postings.groupBy("session", "ord").agg(F.max("len").alias("len"), F.count("*").cast("int").alias("terms"))
    facts = records.select(
        *BLOCK_FACTS, K.conclusion_score(F.col("text")).alias("concl"), K.is_blank(F.col("text")).alias("blank")
    )
    kept = facts.join(first_ords(records), "ord")
    return kept.join(counted, ["session", "ord"], "left").select(
        *BLOCK_FACTS, F.coalesce("len", F.lit(0.0)).alias("len"), F.coalesce("terms", F.lit(0)).alias("terms"), "concl", "blank"
    )


POSTING_ROWS = 1 << 17


def postings_of(records: DataFrame) -> DataFrame:
    """Weighted term counts per block. Rows must lie in partitions by ``ord``: a block's tokens are counted where
    its text lies, without a token shuffle, and a task holds one batch of texts and ``POSTING_ROWS`` entries."""
    facts = records.select("session", "ord", "layer").schema.fields
    schema = T.StructType([
        *facts, T.StructField("token", T.StringType()), T.StructField("tf", T.DoubleType()), T.StructField("len", T.DoubleType()),
    ])
    weights = (V.WEIGHT_TITLE, V.WEIGHT_KEYWORDS, V.WEIGHT_TEXT)

    def weigh(fields: tuple[str | None, ...]) -> tuple[float, Counter[str]]:
        held: Counter[str] = Counter()
        for field, weight in zip(fields, weights):
            for token, n in token_counts(field).items():
                held[token] += n * weight
        return float(held.total()), held

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks, rows, last = [], [], 0, None

        def made() -> pa.RecordBatch:
            sizes = [len(held) for _, held in blocks]
            at = pa.array(np.repeat(np.arange(len(keys)), sizes))
            columns = [pa.array(c, f).take(at) for c, f in zip(zip(*keys), kinds)]
            tokens = pa.array([t for _, held in blocks for t in held], pa.string())
            tf = pa.array(np.fromiter((n for _, held in blocks for n in held.values()), np.float64, sum(sizes)))
            length = pa.array(np.repeat([n for n, _ in blocks], sizes))
            return pa.RecordBatch.from_arrays([*columns, tokens, tf, length], schema.names)

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("session", "ord", "layer")]
            cells = (batch.column(c).to_pylist() for c in ("session", "ord", "layer", "title", "_words", "text"))
            for session, order, layer, *fields in zip(*cells):
                key, (length, held) = (session, order, layer), weigh(fields)
                if key != last:
                    if rows >= POSTING_ROWS:
                        yield made()
                        keys, blocks, rows = [], [], 0
                    last, same = key, {}
                rows += len(held)
                if length in same:  # a repeated block adds to the first
                    same[length].update(held)
                elif held:
                    same[length] = held
                    keys.append(key)
                    blocks.append((length, held))
        if keys:
            yield made()

    texts = records.select("session", "ord", "layer", "title", F.array_join("keywords", " ").alias("_words"), "text")
    return (
        texts.sortWithinPartitions("ord", "session", "layer").mapInArrow(entries, schema)
        .select("session", "ord", "layer", "token", "tf", "len")
    )


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("session", "token").agg(F.count("*").alias("df"))


def corpus_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("session").agg(
        F.count("*").alias("n"), F.avg("len").alias("avgdl")
    )


def assemble(postings: DataFrame, blocks: DataFrame) -> BlockIndex:
    return BlockIndex(postings, blocks, term_stats(postings), corpus_stats(blocks))


def build_index(records: DataFrame) -> BlockIndex:
    kept = first_occurrences(records)
    wide = first_occurrences(records, text_parts(records))
    index = assemble(postings_of(wide), block_stats(kept))
    return replace(index, records=records)
