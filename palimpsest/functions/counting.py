"""``tokens`` of a text in plain Python, for tasks that walk whole texts.

The same words, identifier parts and CJK pairs as the Column expressions of ``functions.tokens``: ``token_list`` in
their order, ``token_counts`` without it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import vocab as V

WORD = re.compile(V.WORD_PATTERN)
BREAK = re.compile(V.IDENTIFIER_BREAK)
SPLIT = re.compile(V.IDENTIFIER_SPLIT)
CJK_RUN = re.compile(f"[{V.CJK}]+")
STOP_WORDS = frozenset(V.STOP_WORDS)
STOP_PAIRS = frozenset(V.STOP_CHARS) | {a + b for a in V.STOP_CHARS for b in V.STOP_CHARS}


def identifier_parts(word: str, lower: str) -> list[str]:
    parts = dict.fromkeys(p.lower() for p in SPLIT.split(word))
    return [p for p in parts if len(p) >= 2 and p != lower and p not in STOP_WORDS]


def cjk_pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 else [run]


def token_counts(text: str | None) -> Counter[str]:
    out: Counter[str] = Counter()
    if not text:
        return out
    for word, n in Counter(WORD.findall(text)).items():
        lower = word.lower()
        if lower not in STOP_WORDS:
            out[lower] += n
        if word >= "A" and BREAK.search(word):
            for part in identifier_parts(word, lower):
                out[part] += n
    if not text.isascii():
        for run in CJK_RUN.findall(text):
            for pair, n in Counter(cjk_pairs(run)).items():
                if pair not in STOP_PAIRS:
                    out[pair] += n
    return out


def token_list(text: str | None) -> list[str]:
    if not text:
        return []
    words = WORD.findall(text)
    out = [w for w in map(str.lower, words) if w not in STOP_WORDS]
    for word in words:
        if word >= "A" and BREAK.search(word):
            out += identifier_parts(word, word.lower())
    if not text.isascii():
        for run in CJK_RUN.findall(text):
            out += [p for p in cjk_pairs(run) if p not in STOP_PAIRS]
    return out


def text_tokens(text: Column) -> Column:
    """``tokens`` of whole texts, made in batches."""

    def made(texts: pa.Array) -> pa.Array:
        lists = [token_list(t) for t in texts.to_pylist()]
        offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array([t for found in lists for t in found], pa.string()))

    return F.arrow_udf(made, "array<string>")(text)
