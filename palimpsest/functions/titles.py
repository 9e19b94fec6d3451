"""Titles and the line predicates used to choose them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.tokens import collapse_ws, let, trim_ws, ws_class


def strip_line_markup(line: Column) -> Column:
    """Remove leading list/heading/quote marks and bold marks."""
    return trim_ws(F.replace(F.regexp_replace(line, V.LINE_LEAD, ""), F.lit("**"), F.lit("")))


def clean_line(line: Column) -> Column:
    bare = F.replace(F.regexp_replace(line, V.LINE_LEAD, ""), F.lit("**"), F.lit(""))
    return trim_ws(F.replace(bare, F.lit("`"), F.lit("")))


def is_continuation(line: Column) -> Column:
    return (
        (F.length(line) < 3)
        | line.rlike(V.CONTINUES_LOWER)
        | line.rlike(V.CONTINUES_MARK)
        | (line.rlike(V.CONTINUES_TAG) & (F.length(line) < 24))
    )


def is_table_row(line: Column) -> Column:
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (pipes >= 3) | F.contains(line, F.lit("---"))


def is_fragment_title(title: Column) -> Column:
    opens = F.length(title) - F.length(F.regexp_replace(title, V.BRACKETS_OPEN, ""))
    closes = F.length(title) - F.length(F.regexp_replace(title, V.BRACKETS_CLOSE, ""))
    return (
        (F.length(title) < 6)
        | title.rlike(V.FRAGMENT_END)
        | title.rlike(V.FRAGMENT_WORD)
        | title.rlike(V.FRAGMENT_START)
        | (opens != closes)
    )


def cut_at_punctuation(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last separator when it lies past 40 %."""

    def cut(x: Column) -> Column:
        upto = F.regexp_extract(F.substring(x, 1, limit), f"(?s)^(.*){V.TITLE_CUT_AT}", 1)
        shorter = let(
            upto,
            lambda u: F.when(F.length(u) >= limit * 0.4, u).otherwise(F.substring(x, 1, limit)),
        )
        return F.when(F.length(x) <= limit, x).otherwise(trim_ws(shorter))

    return let(text, cut)


def nonblank_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trim_ws)
    return F.filter(lines, lambda x: x != "")


def title_of_lines(lines: Column, limit: int = 40, prefer_heading: bool = True) -> Column:
    """Title from trimmed non-blank lines: first heading, else first full line, else any."""

    def usable(x: Column) -> Column:
        return (x != "") & ~F.contains(x, F.lit(V.MARKER))

    heading_mark = ws_class("^#{1,6}[WS]+")

    def choose(ls: Column) -> Column:
        heads = F.filter(
            F.transform(
                F.filter(ls, lambda x: x.rlike(heading_mark + ".")),
                lambda x: clean_line(F.regexp_replace(x, heading_mark, "")),
            ),
            usable,
        )
        plain = let(
            F.filter(F.transform(ls, clean_line), usable),
            lambda cleaned: F.coalesce(
                F.get(F.filter(cleaned, lambda x: ~is_continuation(x)), F.lit(0)),
                F.get(cleaned, F.lit(0)),
                F.lit(""),
            ),
        )
        return F.coalesce(F.get(heads, F.lit(0)), plain) if prefer_heading else plain

    return cut_at_punctuation(let(lines, choose), limit)


def title_of(text: Column, limit: int = 40, prefer_heading: bool = True) -> Column:
    return title_of_lines(nonblank_lines(text), limit, prefer_heading)


def clipped(text: Column, limit: int) -> Column:
    """Whitespace-collapsed text with an ellipsis past ``limit`` characters."""
    return let(
        collapse_ws(F.coalesce(text, F.lit(""))),
        lambda x: F.when(F.length(x) <= limit, x).otherwise(
            F.concat(F.substring(x, 1, limit), F.lit("…"))
        ),
    )


def snippet(text: Column, chars: int = 60) -> Column:
    return clipped(text, max(8, chars))


def preview(text: Column) -> Column:
    return clipped(text, 120)


def session_title(title: Column, first_prompt: Column, fallback: Column) -> Column:
    """Stored title, else the first prompt cut to 28 characters, else the fallback."""
    own = trim_ws(F.coalesce(title, F.lit("")))
    prompt = clipped(first_prompt, 28)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(prompt, F.lit("")), fallback, F.lit(""))


def short_session_id(session: Column) -> Column:
    return F.substring(F.regexp_replace(session, "^session-", ""), 1, 8)


def safe_session_id(session: Column) -> Column:
    safe = F.substring(F.regexp_replace(session, "[^A-Za-z0-9._-]", "_"), 1, 120)
    return F.when(safe == "", F.lit("unknown")).otherwise(safe)


def source_label(src: Column, tool: Column) -> Column:
    named = F.concat(F.lit("工具结果("), tool, F.lit(")"))
    return (
        F.when(F.coalesce(src, F.lit("")) != "tool", F.lit("对话"))
        .when(F.coalesce(tool, F.lit("")) != "", named)
        .otherwise(F.lit("工具结果"))
    )


def time_label(at: Column) -> Column:
    """``YYYY-MM-DD HH:mm`` in the session time zone, empty when ``at`` does not parse."""
    stamp = F.try_to_timestamp(at)
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(""))
