"""Cutting long text into size-bounded blocks, by paragraphs or by summary headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions.tokens import let, trim_ws

_W = "[" + V.WS.replace("\n", "") + "]"
_HEADING = f"{_W}{{0,3}}#{{1,6}}{_W}+[^{V.WS}]"
_NONE = "array<string>"


def slices_at_boundary(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, each cut after its last boundary past half way."""
    pattern = f"(?s).{{1,{limit}}}\\z|.{{{limit // 2},{limit - 1}}}[\n。； ]|.{{{limit}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Runs of lines between blank lines; a heading line also starts a new run."""
    lines = F.transform(
        F.split(text, "\n"), lambda x: F.when(trim_ws(x) == "", F.lit("")).otherwise(x)
    )
    runs = F.split(F.array_join(lines, "\n"), f"\n{{2,}}|\n(?={_HEADING})")
    return F.filter(F.transform(runs, trim_ws), lambda x: x != "")


def _state(blocks: Column, current: Column) -> Column:
    return F.struct(blocks.alias("blocks"), current.alias("current"))


def split_blocks(text: Column, target: int = 420, limit: int = 900) -> Column:
    """Paragraphs packed to ``target`` characters; longer ones are cut to ``limit``."""

    def closed(acc: Column) -> Column:
        return F.when(acc["current"] == "", acc["blocks"]).otherwise(
            F.concat(acc["blocks"], F.array(acc["current"]))
        )

    def place(acc: Column, rest: Column) -> Column:
        joined = F.length(acc["current"]) + F.length(rest) + 1 <= target
        return (
            F.when(rest == "", acc)
            .when(acc["current"] == "", _state(acc["blocks"], rest))
            .when(joined, _state(acc["blocks"], F.concat(acc["current"], F.lit("\n"), rest)))
            .otherwise(_state(closed(acc), rest))
        )

    def step(acc: Column, run: Column) -> Column:
        def pieces_placed(a: Column) -> Column:
            ps = a["ps"]
            heads = F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), trim_ws)
            before = F.when(F.size(ps) > 1, _state(F.concat(closed(a["acc"]), heads), F.lit(""))).otherwise(
                a["acc"]
            )
            return let(
                F.struct(before.alias("acc"), trim_ws(F.element_at(ps, -1)).alias("rest")),
                lambda b: place(b["acc"], b["rest"]),
            )

        return let(
            F.struct(acc.alias("acc"), slices_at_boundary(run, limit).alias("ps")), pieces_placed
        )

    return F.aggregate(
        paragraphs(F.coalesce(text, F.lit(""))), _state(F.array().cast(_NONE), F.lit("")), step, closed
    )


def merge_tiny(blocks: Column, shortest: int = V.TINY_BLOCK_CHARS, limit: int = 900) -> Column:
    """Blocks under ``shortest`` join their left neighbour, or wait for the right one."""

    def absorbed(out: Column, piece: Column) -> Column:
        """``out`` with ``piece`` joined to its last block, or null when it does not fit."""
        last = F.try_element_at(out, F.lit(-1))
        fits = F.length(last) + F.length(piece) + 1 <= limit + shortest
        return F.when(
            (F.size(out) > 0) & fits,
            F.concat(
                F.slice(out, F.lit(1), F.size(out) - 1),
                F.array(F.concat(last, F.lit("\n"), piece)),
            ),
        )

    def step(acc: Column, block: Column) -> Column:
        def one(a: Column) -> Column:
            tiny = F.length(a["piece"]) < shortest
            joined = absorbed(a["out"], a["piece"])
            return (
                F.when(~tiny, _state(F.concat(a["out"], F.array(a["piece"])), F.lit("")))
                .when(joined.isNotNull(), _state(joined, F.lit("")))
                .otherwise(_state(a["out"], a["piece"]))
            )

        piece = F.concat_ws("\n", F.nullif(acc["current"], F.lit("")), block)
        return let(F.struct(acc["blocks"].alias("out"), piece.alias("piece")), one)

    def finish(acc: Column) -> Column:
        rest = acc["current"]
        return F.when(rest == "", acc["blocks"]).otherwise(
            F.coalesce(absorbed(acc["blocks"], rest), F.concat(acc["blocks"], F.array(rest)))
        )

    merged = F.aggregate(blocks, _state(F.array().cast(_NONE), F.lit("")), step, finish)
    return F.filter(merged, lambda x: trim_ws(x) != "")


def summary_sections(text: Column, target: int = 500, limit: int = 900) -> Column:
    """A summary cut per heading; every piece of a section carries its heading."""
    mark = f"^{_W}{{0,3}}#{{1,6}}{_W}+"

    def section(run: Column) -> Column:
        first = F.substring_index(run, "\n", 1)
        headed = first.rlike(f"^{_HEADING}")
        heading = F.when(headed, F.concat(F.lit("## "), trim_ws(F.regexp_replace(first, mark, "")))).otherwise("")
        body = F.when(headed, run.substr(F.length(first) + 1, F.length(run))).otherwise(run)
        return let(F.struct(heading.alias("h"), trim_ws(body).alias("b")), pieces)

    def pieces(s: Column) -> Column:
        named = F.transform(
            split_blocks(s["b"], target, limit),
            lambda p: F.concat_ws("\n", F.nullif(s["h"], F.lit("")), p),
        )
        cut = F.flatten(
            F.transform(named, lambda p: F.filter(
                slices_at_boundary(p, limit), lambda x, i: (i == 0) | (trim_ws(x) != "")))
        )
        return (
            F.when((s["b"] == "") & (s["h"] == ""), F.array().cast(_NONE))
            .when(s["b"] == "", F.array(s["h"]))
            .otherwise(cut)
        )

    runs = F.split(F.coalesce(text, F.lit("")), f"\n(?={_HEADING})")
    return merge_tiny(F.flatten(F.transform(runs, section)), V.TINY_BLOCK_CHARS, limit)
