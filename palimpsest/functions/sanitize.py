"""Cleaning of stored text: sentinel paragraphs, imitation headers, content blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.tokens import trim_ws, ws_class

_MARK = ws_class(V.MARKER_PATTERN)
_MARK_START = ws_class("^[WS]*") + _MARK
_FAKE_START = ws_class("^[WS]*") + V.FAKE_HEADER_PREFIX


def _mask_marks(col: Column) -> Column:
    return F.regexp_replace(col, _MARK, V.MARKER_REPLACEMENT)


def strip_markers(text: Column) -> Column:
    """Drop paragraphs and lines that open with the sentinel; mask it elsewhere."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, "\n{2,}"), lambda p: ~p.rlike(_MARK_START))
    lines = F.filter(
        F.split(F.array_join(paragraphs, "\n\n"), "\n"), lambda x: ~x.rlike(_MARK_START)
    )
    cleaned = trim_ws(F.array_join(F.transform(lines, _mask_marks), "\n"))
    return F.when(F.contains(text, F.lit("⟦")), cleaned).otherwise(text)


def _has_fingerprint(col: Column) -> Column:
    found = F.lit(False)
    for needle in V.HEADER_FINGERPRINTS:
        found = found | F.contains(col, F.lit(needle))
    return found


def neutralize_headers(text: Column) -> Column:
    """Replace lines that imitate an injected header, then mask sentinels."""
    text = F.coalesce(text, F.lit(""))

    def line(x: Column) -> Column:
        return F.when(_has_fingerprint(x), F.lit(V.HEADER_REMOVED)).otherwise(
            F.regexp_replace(x, _FAKE_START, V.FAKE_HEADER_REPLACEMENT)
        )

    rewritten = F.array_join(F.transform(F.split(text, "\n"), line), "\n")
    suspicious = _has_fingerprint(text) | text.rlike(_FAKE_START)
    return _mask_marks(F.when(suspicious, rewritten).otherwise(text))


def sanitize(text: Column) -> Column:
    return strip_markers(neutralize_headers(text))


def text_of_blocks(blocks: Column) -> Column:
    """Join the text blocks of ``array<struct<type,text>>``; other block types are ignored."""
    kept = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    joined = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return F.coalesce(trim_ws(joined), F.lit(""))
