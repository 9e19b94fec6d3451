"""Loose parsing of model answers: JSON fragments, page picks, time intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.timewords import normalize_intent
from palimpsest.functions.tokens import trim_ws

_NO_STRINGS = "array<string>"


def _between(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to the last closer, or null."""
    text = F.coalesce(text, F.lit(""))
    first = F.instr(text, opener)
    last = F.length(text) - F.instr(F.reverse(text), closer) + 1
    found = (first > 0) & F.contains(text, F.lit(closer)) & (last > first)
    return F.when(found, text.substr(first, last - first + 1))


def _strings(items: Column) -> Column:
    """Only JSON strings (quoted, so numbers stay out), trimmed, 24 characters, at most 12."""
    texts = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.substring(trim_ws(F.try_variant_get(v, "$", "string")), 1, 24),
    )
    return F.slice(F.filter(texts, lambda x: x != ""), 1, 12)


def loose_object(text: Column) -> Column:
    """The outermost ``{…}`` as a variant, null when it is not a JSON object."""
    value = F.try_parse_json(_between(text, "{", "}"))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def loose_array(text: Column) -> Column:
    """Strings of the outermost ``[…]``; null when it is not a JSON array."""
    value = F.try_parse_json(_between(text, "[", "]"))
    return _strings(F.try_variant_get(value, "$", "array<variant>"))


def focused_rewrite(text: Column) -> Column:
    """``struct<point, terms, intent>`` of a rewrite answer, object or bare array form."""
    obj = loose_object(text)

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(obj, f"$['{name}']", kind)

    def is_text(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(obj, f"$['{name}']", "variant")) == "STRING"

    terms = F.lit(None).cast(_NO_STRINGS)
    for name in reversed(["关键词", "keywords", "terms"]):
        found = _strings(field(name, "array<variant>"))
        terms = F.when(F.size(found) > 0, found).otherwise(terms)
    point = F.when(is_text("点"), F.substring(trim_ws(field("点", "string")), 1, 120))
    intent = F.lit("none")
    for name in reversed(["时间意图", "time_intent", "timeIntent", "intent"]):
        intent = F.when(is_text(name), normalize_intent(field(name, "string"))).otherwise(intent)
    listed = loose_array(text)
    bare = F.when(
        F.size(listed) > 0,
        F.struct(F.lit("").alias("point"), listed.alias("terms"), F.lit("none").alias("intent")),
    )
    full = F.when(
        F.size(terms) > 0,
        F.struct(
            F.coalesce(point, F.lit("")).alias("point"), terms.alias("terms"), intent.alias("intent")
        ),
    )
    return F.when(obj.isNotNull(), full).otherwise(bare)


def page_pick(answer: Column, count: Column) -> Column:
    """``struct<kind, index>``: empty, none, found (exactly one number in range) or unclear."""
    raw = trim_ws(F.coalesce(answer, F.lit("")))
    numbers = F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0))
    index = F.get(numbers, F.lit(0)).try_cast("bigint")
    ok = (F.size(numbers) == 1) & (index >= 1) & (index <= count)
    kind = (
        F.when(raw == "", "empty")
        .when(raw.rlike(r"(?i)\bNONE\b"), "none")
        .when(F.coalesce(ok, F.lit(False)), "found")
        .otherwise("unclear")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "found", index).otherwise(F.lit(0).cast("bigint")).alias("index"),
    )


def page_intent(answer: Column) -> Column:
    """The one intent word in a page answer; ``NONE`` is the answer sentinel, not an intent."""
    low = F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"\bNONE\b", " "))
    words = F.array_distinct(
        F.filter(
            F.regexp_extract_all(low, F.lit("[a-z_]+"), F.lit(0)),
            lambda w: w.isin(list(V.INTENT_SHAPES)),
        )
    )
    rest = F.filter(words, lambda w: w != "none")
    return (
        F.when(F.size(words) == 1, F.get(words, F.lit(0)))
        .when((F.size(words) > 1) & (F.size(rest) == 1), F.get(rest, F.lit(0)))
    )


def merged_keywords(original: Column, generated: Column, limit: int = 10) -> Column:
    both = F.transform(
        F.concat(
            F.coalesce(original, F.array().cast(_NO_STRINGS)),
            F.coalesce(generated, F.array().cast(_NO_STRINGS)),
        ),
        trim_ws,
    )
    return F.slice(F.array_distinct(F.filter(both, lambda x: x != "")), 1, limit)


def concentration(query: Column, terms: Column, gap: int = 200) -> Column:
    """Where the terms first occur in the query: hits, missing, span and clusters."""
    needles = F.filter(F.transform(terms, trim_ws), lambda t: t != "")
    places = F.transform(needles, lambda t: F.call_function("instr", query, t) - 1)
    found = F.array_sort(F.filter(places, lambda p: p >= 0))
    n = F.size(found)
    first = F.get(found, F.lit(0))
    last = F.get(found, n - 1)
    jumps = F.filter(
        found, lambda p, i: (i > 0) & (p - F.coalesce(F.get(found, i - 1), p) > max(1, gap))
    )
    span = F.coalesce(last - first, F.lit(0))
    ratio = F.when(F.length(query) == 0, F.lit(0.0)).otherwise(F.round(span / F.length(query), 4))
    return F.struct(
        n.alias("hits"),
        (F.size(needles) - n).alias("missing"),
        F.coalesce(first, F.lit(-1)).alias("first"),
        F.coalesce(last, F.lit(-1)).alias("last"),
        span.alias("span"),
        F.when(n == 0, F.lit(0.0)).otherwise(ratio).alias("span_ratio"),
        F.when(n == 0, F.lit(0)).otherwise(F.size(jumps) + 1).alias("clusters"),
    )
