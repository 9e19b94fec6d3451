"""Time references in a question and the re-rank shape they ask for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.tokens import trim_ws, ws_class


def class_pattern(name: str) -> str:
    terms = [re.sub(r" +", ws_class("[WS]+"), t) for t in V.TIME_WORDS[name]]
    return "|".join(terms)


def any_pattern() -> str:
    return "|".join(class_pattern(name) for name in V.TIME_WORDS)


def has_time_reference(text: Column) -> Column:
    return F.lower(text).rlike(any_pattern())


def time_shape(text: Column) -> Column:
    """Shape of the single class mentioned; null when none or several classes occur."""
    low = F.lower(F.coalesce(text, F.lit("")))
    flags = {name: low.rlike(class_pattern(name)) for name in V.TIME_WORDS}
    hits = sum((f.cast("int") for f in flags.values()), start=F.lit(0))
    shape = F.when(hits != 1, F.lit(None).cast("string"))
    for name, flag in flags.items():
        shape = shape.when(flag, F.lit(V.TIME_SHAPES[name]))
    return shape


def time_windows(text: Column) -> Column:
    """Zero-based ``[start, end)`` of every sentence that holds a time reference."""
    bound = f"\n{V.SENTENCE_END}"
    pieces = F.regexp_extract_all(
        text, F.lit(f"(?i)(?:{any_pattern()}|[^{bound}])++|[{bound}]"), F.lit(0)
    )
    start = F.struct(
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("at")
    )

    def step(acc: Column, piece: Column) -> Column:
        lead = F.length(piece) - F.length(F.ltrim(piece, F.lit(V.WS)))
        span = F.struct(
            (acc["at"] + lead).cast("int").alias("start"),
            (acc["at"] + lead + F.length(trim_ws(piece))).cast("int").alias("end"),
        )
        spans = F.when(has_time_reference(piece), F.concat(acc["spans"], F.array(span))).otherwise(
            acc["spans"]
        )
        return F.struct(spans.alias("spans"), (acc["at"] + F.length(piece)).alias("at"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def intent_shape(intent: Column) -> Column:
    word = F.lower(trim_ws(F.coalesce(intent, F.lit(""))))
    shape = F.lit(None).cast("string")
    for name, value in V.INTENT_SHAPES.items():
        if value is not None:
            shape = F.when(word == name, F.lit(value)).otherwise(shape)
    return shape


def normalize_intent(intent: Column) -> Column:
    word = F.lower(trim_ws(F.coalesce(intent, F.lit(""))))
    return F.when(word.isin(list(V.INTENT_SHAPES)), word).otherwise(F.lit("none"))
