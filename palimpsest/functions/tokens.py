"""Tokens, token sets, lengths and set similarity as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V


FLOOR_CHARS = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A Column used twice is an expression tree copied twice; binding it as a lambda variable
    keeps long expressions linear. The binding is the start value of an empty fold: reading an item of
    an array instead makes Spark derive the type of everything nested below it for every row, twice a level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def ws_class(pattern: str) -> str:
    """Expand ``[WS]`` in a pattern to the explicit whitespace class."""
    return pattern.replace("[WS]", "[" + V.WS + "]")


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(V.WS))


def collapse_ws(col: Column) -> Column:
    """Every whitespace run becomes one space; ends are trimmed."""
    return trim_ws(F.regexp_replace(col, ws_class("[WS]+"), " "))


def is_blank(col: Column) -> Column:
    return trim_ws(col) == ""


def _not_stop(col: Column) -> Column:
    return ~col.isin(V.STOP_WORDS)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.WORD_PATTERN), F.lit(0))


def _surface_words(ws: Column) -> Column:
    return F.filter(F.transform(ws, F.lower), _not_stop)


def _is_compound(w: Column) -> Column:
    """Whether a word holds ``IDENTIFIER_BREAK``; plain byte tests settle nearly all words. Numbers sort first."""
    marked = F.lit(False)
    for mark in V.IDENTIFIER_MARKS:
        marked = marked | F.contains(w, F.lit(mark))
    return (w >= "A") & (marked | ((w != F.lower(w)) & w.rlike(V.IDENTIFIER_BREAK)))


def _identifier_parts(ws: Column) -> Column:
    compound = F.filter(ws, _is_compound)
    return F.flatten(
        F.transform(
            compound,
            lambda w: F.filter(
                F.array_distinct(F.transform(F.split(w, V.IDENTIFIER_SPLIT), F.lower)),
                lambda p: (F.length(p) >= 2) & (p != F.lower(w)) & _not_stop(p),
            ),
        )
    )


def cjk_bigrams(text: Column) -> Column:
    """Overlapping character pairs of each CJK run; an isolated character stands alone.

    The zero-width look-ahead walks the text once, so a run of any length stays linear.
    """
    c = f"[{V.CJK}]"
    pattern = f"(?=({c}{{2}}|(?<!{c}){c}(?!{c})))"
    pairs = F.filter(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        lambda p: ~p.rlike(f"^[{V.STOP_CHARS}]{{1,2}}$"),
    )
    # a text of as many bytes as characters is plain ASCII
    some = (F.octet_length(text) > F.length(text)) & text.rlike(c)
    return F.when(some, pairs).otherwise(F.array().cast("array<string>"))


def surface_terms(text: Column) -> Column:
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.concat(_surface_words(words(t)), cjk_bigrams(t)),
    )


def tokens(text: Column) -> Column:
    """All tokens with repeats: whole words, parts of compound identifiers, CJK pairs."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.concat(
            let(words(t), lambda ws: F.concat(_surface_words(ws), _identifier_parts(ws))),
            cjk_bigrams(t),
        ),
    )


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def evidence_floor(text: Column) -> Column:
    """Matched tokens a block needs before it may be returned for this query."""
    whole = F.size(F.array_distinct(surface_terms(text)))
    # no token holds a space: a beginning that ends before one shows the text's own first tokens
    begun = F.regexp_replace(F.substring(text, 1, FLOOR_CHARS), "[^ ]*$", "")
    settled = (F.length(text) > FLOOR_CHARS) & (F.size(F.array_distinct(surface_terms(begun))) >= V.EVIDENCE_FLOOR)
    return F.when(settled, F.lit(V.EVIDENCE_FLOOR)).otherwise(F.least(F.lit(V.EVIDENCE_FLOOR), whole))


def estimate_tokens(text: Column) -> Column:
    ink = F.regexp_replace(F.coalesce(text, F.lit("")), ws_class("[WS]+"), "")

    def units(x: Column) -> Column:
        other = F.length(F.regexp_replace(x, f"[{V.CJK}]+", ""))
        return let(
            other, lambda o: F.ceil((F.length(x) - o) * F.lit(0.85) + o / F.lit(4.0)).cast("int")
        )

    return let(ink, units)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 when either is empty."""
    shared = let(
        F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n)
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared)


def containment(a: Column, b: Column) -> Column:
    """Share of the set ``a`` found in ``b``; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)
    )


def conclusion_score(text: Column) -> Column:
    hits = sum(
        (F.contains(text, F.lit(m)).cast("int") for m in V.CONCLUSION_MARKERS), start=F.lit(0)
    )
    return F.least(F.lit(1.0), hits / F.lit(4.0))


def is_conclusion(text: Column) -> Column:
    return conclusion_score(text) > 0


def fingerprint(layer: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat(layer, F.lit("\u0000"), text)), 1, 16)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def round_half_up(col: Column, digits: int) -> Column:
    """Rounding by floor(x·10^d + 0.5), as stored scores are rounded."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / scale
