"""Making block records: fingerprint, title, keywords, first-occurrence dedupe."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import tokens as K
from palimpsest.functions.counting import token_counts
from palimpsest.functions.titles import title_of
from palimpsest.session import spread

RECORD_COLUMNS = [
    "session", "ord", "layer", "compaction_id", "at", "turn", "seq_start", "seq_end",
    "shadowed_tokens", "title", "keywords", "text", "fp", "src", "tool",
]


KEYWORDS_MOST = 12


def top_tokens(rows: list[tuple[str | None, str | None, int | None]]) -> list[str]:
    """Top tokens of the (text, title, limit) rows of one ident, counted together."""
    counted: Counter[tuple[int | None, str, bool]] = Counter()
    for text, title, limit in rows:
        named = token_counts(title)
        for token, n in token_counts(text).items():
            counted[limit, token, token in named] += n
    scored = []
    for (limit, token, named), n in counted.items():
        size = len(token)
        score = n + 1.5 * named + 0.5 * (size >= 2) - (n == 1 and size > 12)
        if score > 0:
            scored.append((-score, token, limit))
    best = heapq.nsmallest(KEYWORDS_MOST, scored, key=lambda s: s[:2])
    return [token for rank, (_, token, limit) in enumerate(best, 1) if limit is not None and rank <= limit]


def with_keywords(df: DataFrame, ident: str, text: str, title: str, limit: Column) -> DataFrame:
    """Adds ``keywords``, the top tokens of each ident's texts.

    Rows must lie in partitions by ``ident``. Tokens are counted where the texts lie, so only whole texts are
    shuffled, and a task holds one batch of them and the rows of one ident.
    """
    rows = df.withColumn("_limit", limit.cast("int")).sortWithinPartitions(ident)
    names = df.columns

    def filled(batch: pa.RecordBatch, ids: list) -> pa.RecordBatch:
        inputs = list(zip(*(batch.column(c).to_pylist() for c in (text, title, "_limit"))))
        words, low = [], 0
        for high in range(1, len(ids) + 1):
            if high == len(ids) or ids[high] != ids[low]:
                words += [top_tokens(inputs[low:high])] * (high - low)
                low = high
        return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(words, pa.list_(pa.string()))], [*names, "keywords"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = batch.column(ident).to_pylist()
            if not ids:
                continue
            cut = len(ids)  # where the batch's last ident begins; it may go on in the next batch
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if held and (cut or last != ids[-1]):
                head = pa.concat_batches([*held, batch.slice(0, cut)])
                yield filled(head, head.column(ident).to_pylist())
                held = []
            elif cut:
                yield filled(batch.slice(0, cut), ids[:cut])
            held.append(batch.slice(cut))
            last = ids[-1]
        if held:
            tail = pa.concat_batches(held)
            yield filled(tail, tail.column(ident).to_pylist())

    schema = T.StructType([*df.schema.fields, T.StructField("keywords", T.ArrayType(T.StringType()))])
    return rows.mapInArrow(fill, schema)


def keywords_by_id(df: DataFrame, ident: str, text: str, title: str, limit: Column, parts: int | None = None) -> DataFrame:
    """Top tokens of each text: ``(ident, keywords)``; texts without tokens give no row."""
    rows = spread(df.select(ident, text, title, limit.alias("_most")), ident, parts=parts)
    found = with_keywords(rows, ident, text, title, F.col("_most")).where(F.size("keywords") > 0)
    return found.select(ident, "keywords").dropDuplicates([ident])


def finish_records(blocks: DataFrame, *, title_from: str = "text", parts: int | None = None) -> DataFrame:
    """Add title, keywords and fingerprint to ``session, ord, layer, text, …`` blocks.

    Summary blocks keep 8 keywords and may take a heading as title; raw blocks keep 10 and
    never use headings. ``ord`` must be unique. ``parts`` is the number of tasks that share the texts.
    """
    is_summary = F.col("layer") == "summary"
    titled = spread(blocks, "ord", parts=parts).withColumn(
        "title",
        F.when(is_summary, title_of(F.col(title_from), 40)).otherwise(
            title_of(F.col(title_from), 40, prefer_heading=False)
        ),
    )
    named = with_keywords(titled, "ord", "text", "title", F.when(is_summary, 8).otherwise(10))
    return named.withColumns({
        "keywords": F.when(F.col("ord").isNotNull(), F.col("keywords")).otherwise(F.array().cast("array<string>")),
        "fp": K.fingerprint(F.col("layer"), F.col("text")),
    }).select("ord", *(c for c in named.columns if c != "ord"), "fp")


def identity_key() -> Column:
    fallback = F.concat_ws("\u0000", "layer", "title", F.length("text").cast("string"))
    return F.when(F.coalesce(F.col("fp"), F.lit("")) == "", fallback).otherwise(F.col("fp"))


def first_ords(records: DataFrame) -> DataFrame:
    """``ord`` of the earliest record of each identity in a session, once.

    Join it as an inner join: a semi join is pushed below the columns made from a text, or below the shuffle that spreads
    texts, and then whole texts go through the session's shuffle width."""
    return (
        records.select("session", identity_key().alias("_key"), "ord")
        .groupBy("session", "_key")
        .agg(F.min("ord").alias("ord"))
        .select("ord").distinct()
    )


def first_occurrences(records: DataFrame, parts: int | None = None) -> DataFrame:
    """One record per identity in a session, the earliest by ``ord``.

    Only (session, key, ord) is aggregated, with map-side combine, so a group of copies of any
    size shrinks before the shuffle; the texts are then reached by a join on ``ord``. With
    ``parts`` they are spread that wide before the join, which keeps the width.
    """
    rows, first = records, first_ords(records)
    if parts is not None:  # both sides, or the join moves the texts to the narrower one's width
        rows, first = spread(rows, "ord", parts=parts), spread(first, "ord", parts=parts)
    return rows.join(first, "ord").select(*records.columns)
