"""Periodic runs of words, found by an online sparse diagonal programme.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
max(``SHORTEST``, ``TIMES`` * q) that no neighbouring word extends. A diagonal of lag q holds how many words in
a row matched the word q before. Each word increments the match lengths of the active diagonals, opens those of
its earlier occurrences, and a diagonal that a word ends emits its run at once if it is long enough.

Opening a diagonal for every earlier occurrence would cost the square of a word's frequency. Only occurrences
that can belong to a run open one: for lags in (k/2, k], k a power of two, the nearest earlier occurrence of the
last k words. That loses nothing: a run of period q and at least 4q words holds a place whose last k < 2q words
also stand q before inside the run, and a nearer occurrence would give the run a smaller period. So what opens
is primitive as well, and a word opens at most one diagonal per power of two. Sequences of k words are numbered
exactly by pairs of sequences of k/2 words, and only those that occur twice are carried on, so the work follows
the repeated sequences and stays near linear in the words, whatever repeats.

All documents of a slice of a batch are numbered together by array operations; the programme itself visits only
the places where a diagonal opens or is active. A document is read whole by one task.

Defined results: null and empty texts have no words and no runs; rows repeat as given, null keys included; an
empty table gives no rows; columns of the input beyond key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 6
TIMES = 4
BATCH_WORDS = 100_000

#: (key, number of words) -> places of the words that the text is made of, or None for the text as it is
Edit = Callable[[int | None, int], np.ndarray | None]

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def openings(words: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
    """place -> lags of the diagonals that open there.

    ``words`` are numbers, different ones for different documents; ``ends`` is the end of each word's document.
    """
    found: dict[int, list[int]] = {}
    at, ids, k = np.arange(len(words)), words, 1
    scratch = np.full(len(words) + 1, -1, np.int64)
    while len(at):
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        later, before = at[order[1:][same]], at[order[:-1][same]]
        lag = later - before
        fits = (2 * lag > k) & (lag <= k)
        for i, q in zip((later[fits] + k - 1).tolist(), lag[fits].tolist()):
            found.setdefault(i, []).append(q)
        # sequences of 2k words: pairs of sequences of k words, both of which occur twice
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, ids = at[twice], ids[twice]
        scratch[at] = ids
        fits = at + 2 * k <= ends[at]
        second = np.full(len(at), -1, np.int64)
        second[fits] = scratch[at[fits] + k]
        scratch[at] = -1
        both = second >= 0
        at, pairs = at[both], ids[both] * (len(words) + 1) + second[both]
        ids = np.unique(pairs, return_inverse=True)[1]
        k *= 2
    return found


def periodic_runs(words: list[int], opened: dict[int, list[int]], first: int, end: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by start and period of the runs of ``words[first:end]``."""
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}

    def emit(q: int, matched: int, stop: int) -> None:
        length = matched + q
        if length >= max(SHORTEST, TIMES * q):
            runs.append((stop - length - first, length, q))

    i = first
    waiting = [p for p in sorted(opened) if first <= p < end]
    for n, place in enumerate(waiting):
        i = place
        for q in opened[place]:
            if q not in active:
                # the match began where the words before it differ
                start = place
                while start - 1 - q >= first and words[start - 1] == words[start - 1 - q]:
                    start -= 1
                active[q] = place - start
        until = waiting[n + 1] if n + 1 < len(waiting) else end
        while active and i < until:
            word = words[i]
            for q in list(active):
                if words[i - q] == word:
                    active[q] += 1
                else:
                    emit(q, active.pop(q), i)
            i += 1
    for q, matched in active.items():
        emit(q, matched, end)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None) -> DataFrame:
    """``key``, n_words, runs (by start, then period) and collapsed: the words without those that a run repeats
    after its first period, joined by one space. Words are separated by space and \\x09-\\x0D."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            number: dict[bytes, int] = {}
            flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
            last = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(texts)), sizes)
            opened = openings(np.unique(doc * max(1, len(number)) + flat, return_inverse=True)[1], last[doc])
            by_doc: dict[int, dict[int, list[int]]] = {}
            for place, lags in opened.items():
                by_doc.setdefault(int(doc[place]), {})[place] = lags
            runs: list[list[dict]] = [[] for _ in texts]
            collapsed = []
            for d, t in enumerate(texts):
                if d in by_doc:
                    first = int(last[d] - sizes[d])
                    here = {p - first: lags for p, lags in by_doc[d].items()}
                    found = periodic_runs(flat[first : last[d]].tolist(), here, 0, len(t))
                    runs[d] = [{"start": s, "length": n, "period": q} for s, n, q in found]
                    keep = np.ones(len(t), bool)
                    for s, n, q in found:
                        keep[s + q : s + n] = False
                    t = [t[i] for i in np.flatnonzero(keep)]
                collapsed.append(b" ".join(t).decode())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes), pa.array(runs, RUNS), pa.array(collapsed, pa.string())],
                ["key", "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1)):
                k, words = k.as_py(), (t.as_py() or "").encode().split()
                places = edit(k, len(words)) if edit else None
                keys.append(k)
                texts.append(words if places is None else [words[i] for i in places])
                held += len(texts[-1])
                if held >= BATCH_WORDS:
                    yield solve(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield solve(keys, texts)

    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(of, SCHEMA).withColumnRenamed("key", key)
