"""Sentences, query segments, repeat folding and head/tail sampling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lines import PIECE, SENTENCE, folded
from palimpsest.functions.titles import strip_line_markup
from palimpsest.functions.tokens import let, trim_ws

def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Sentences closed by a terminator; an open line continues into the next piece.

    Terminators only occur at the end of a cleaned piece, so joining the pieces with a space
    and cutting after every terminator gives the merged sentences in one linear pass.
    """
    pieces = F.filter(
        F.transform(_all(F.coalesce(text, F.lit("")), PIECE), strip_line_markup),
        lambda p: p != "",
    )
    merged = F.transform(_all(F.array_join(pieces, " "), SENTENCE), trim_ws)
    return F.filter(merged, lambda p: p != "")


def fold_adjacent_sentences(text: Column) -> Column:
    """Drop sentences equal to their left neighbour, then fold whole-text repeats; made in batches."""

    def made(texts: pa.Array) -> pa.Array:
        return pa.array((folded(t.as_py()) for t in texts), pa.string())

    return F.arrow_udf(made, "string")(text)


def sample_head_tail(text: Column, limit: Column | int, share: float | Column = 0.75) -> Column:
    """At most ``limit`` characters: the head, an ellipsis and the tail."""
    limit = F.greatest(F.lit(0), limit if isinstance(limit, Column) else F.lit(limit))
    share = share if isinstance(share, Column) else F.lit(float(share))
    share = F.least(F.lit(0.9), F.greatest(F.lit(0.1), share))

    def sample(args: Column) -> Column:
        t, m, head = args["t"], args["m"], args["head"]
        n, tail = F.length(t), F.greatest(F.lit(1), m - 1 - head)
        both = F.concat(t.substr(F.lit(1), head), F.lit("…"), t.substr(n - tail + 1, tail))
        return (
            F.when(n <= m, t)
            .when(m <= 2, F.lit("…").substr(F.lit(1), m))
            .when(n - tail <= head, t.substr(F.lit(1), m - 1))
            .otherwise(both)
        )

    head = F.greatest(F.lit(1), F.least(limit - 2, F.floor((limit - 1) * share).cast("int")))
    return let(F.struct(text.alias("t"), limit.alias("m"), head.alias("head")), sample)


def query_segments(text: Column, min_chars: int = 6) -> Column:
    """Search units of a question: clauses, with questions alone and short pieces merged.

    A fold over the clauses of one question: ``open`` is the short piece still waiting for a
    neighbour, ``out`` the units already placed.
    """
    clauses = F.flatten(
        F.transform(split_sentences(text), lambda s: _all(s, "[^：:、；;]+[：:、；;]?|[：:、；;]"))
    )

    def asks(x: Column) -> Column:
        return x.rlike("[？?]")

    def land(acc: Column) -> Column:
        out, waiting = acc["out"], acc["open"]
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & ~asks(F.coalesce(last, F.lit("")))
        return F.when(waiting == "", out).otherwise(
            F.when(
                joins,
                F.concat(
                    F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))),
                    F.array(F.concat(last, F.lit(" "), waiting)),
                ),
            ).otherwise(F.concat(out, F.array(waiting)))
        )

    def step(acc: Column, piece: Column) -> Column:
        merged = F.concat_ws(" ", F.nullif(acc["open"], F.lit("")), piece)
        wait = F.length(merged) < max(2, min_chars)
        return (
            F.when(asks(piece), F.struct(
                F.concat(land(acc), F.array(piece)).alias("out"), F.lit("").alias("open")))
            .when(wait, F.struct(acc["out"].alias("out"), merged.alias("open")))
            .otherwise(F.struct(
                F.concat(acc["out"], F.array(merged)).alias("out"), F.lit("").alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))

    def units(cs: Column) -> Column:
        folded = F.filter(F.aggregate(cs, start, step, land), lambda x: trim_ws(x) != "")
        return F.when(F.size(cs) <= 1, F.array(trim_ws(text))).otherwise(folded)

    return F.when(
        trim_ws(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")
    ).otherwise(let(clauses, units))
