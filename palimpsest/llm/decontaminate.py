"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Every training passage (overlapping windows of a document's words) is a query against the inverted index of
the test items; all items above a threshold are retrieved, and a hit counts if the item really occurs around the passage: the
shingles of the whole item are contained to ``WHOLE``, or those of its question and of its answer, which may
then stand apart, to ``QUESTION`` and ``ANSWER``. A changed word in a short answer alone vetoes nothing.

The index holds sections: an item of at most ``STRIDE`` words is one, a longer item is cut evenly into several,
so each section lies whole in some passage wherever it stands. Scores are BM25 contributions of a section's terms,
divided by the section's own full score, so a passage that holds it scores 1 and the threshold does not depend on
the length of an item. A retrieved section stands for its item, which is verified as a whole in the passage and
as many words as the item has on either side, whatever other items there are.

* *Index*: postings by term with the largest contribution of each list and of each block of 64 postings. It
  is built by Spark, in pieces of at most ``SHARD_TERMS`` item words; passages meet one piece after another,
  so what a task holds is bounded however large the benchmark is.
* *Pivoting for a batch*: an item's weak terms together stay below the threshold, so a passage can only reach
  it with some of its strong (rare) terms. One pass over a document's words marks the strong ones; passages
  whose strong upper bounds plus the weak remainder miss the threshold end there.
* *Block-max WAND* runs for the passages that are left: cursors by item number, the pivot by list bounds,
  then by block bounds; only items whose block bounds reach the threshold are scored.

Defined results: null and empty texts hold no passage and match nothing; a null item text is no item; equal
items are separate items; repeated rows give repeated results; an empty table gives no rows. An item of one
sentence has its last third of words as the answer; parts shorter than five words count as one shingle. Shingles
of a whole item have five words, fewer below 24 words, so that one changed word never breaks a quarter of them;
items of fewer than nine words, too short to tell an edit from another phrase, keep five.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

WORD = re.compile(r"\w+")
PASSAGE, STRIDE = 192, 96
K1, B = 1.2, 0.75
THRESHOLD = 0.6
WEAK = 0.35
QUESTION, ANSWER, WHOLE = 0.75, 0.75, 0.75
SHINGLE = 5
POSTINGS_BLOCK = 64
SHARD_TERMS = 1_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, or the last third of a single sentence."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    if cut and words_of(text[: cut[-1]]) and words_of(text[cut[-1] :]):
        return text[: cut[-1]], text[cut[-1] :]
    words = text.split()
    at = len(words) - max(1, len(words) // 3)
    return (" ".join(words[:at]), " ".join(words[at:])) if at else (text, "")


def section_starts(length: int) -> list[int]:
    """Bounds of the sections of an item of ``length`` words."""
    parts = max(1, -(-length // STRIDE))
    return [k * length // parts for k in range(parts + 1)]


def whole_shingle(length: int) -> int:
    """Words in a shingle of a whole item: one changed word breaks at most a quarter of an item's shingles."""
    return SHINGLE if length < 9 else min(SHINGLE, (length + 1) // 5)


def contained(part: list[str], words: list[str], shingle: int = SHINGLE) -> float:
    """Share of the part's distinct shingles that occur in ``words``; shorter parts are one shingle."""
    n = min(shingle, len(part))
    if not n:
        return 1.0
    wanted = set(zip(*(part[i:] for i in range(n))))
    return len(wanted.intersection(zip(*(words[i:] for i in range(n))))) / len(wanted)


class Index:
    """Inverted index of the sections of a bounded set of items."""

    def __init__(self, items: list[tuple[int, str, str]], idf: dict[str, float], mean: float) -> None:
        self.ids = [i for i, _, _ in items]
        self.question = [words_of(q) for _, q, _ in items]
        self.answer = [words_of(a) for _, _, a in items]
        self.item_of: list[int] = []
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        sections = []
        for n, (q, a) in enumerate(zip(self.question, self.answer)):
            whole, bounds = q + a, section_starts(len(q) + len(a))
            sections += [whole[low:high] for low, high in zip(bounds, bounds[1:])]
            self.item_of += [n] * (len(bounds) - 1)
        for n, words in enumerate(sections):
            counts: dict[str, int] = defaultdict(int)
            for w in words:
                counts[w] += 1
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
            full = sum(weight.values()) or 1.0
            for w in weight:
                lists[w].append((n, weight[w] / full))
        self.terms = list(lists)
        self.number = {w: t for t, w in enumerate(self.terms)}
        self.docs = [[n for n, _ in lists[w]] for w in self.terms]
        self.impacts = [[v for _, v in lists[w]] for w in self.terms]
        self.top = [max(v) for v in self.impacts]
        self.block_top = [[max(v[i : i + POSTINGS_BLOCK]) for i in range(0, len(v), POSTINGS_BLOCK)] for v in self.impacts]
        # weak terms: the most common ones, short words first, as long as no item gets more than WEAK from them
        # together; which terms are weak changes the work, never the result
        mass = np.zeros(len(sections))
        self.strong: dict[str, int] = {}
        for w in sorted(self.terms, key=lambda w: (-len(lists[w]), len(w), w)):
            at, v = self.docs[self.number[w]], np.array(self.impacts[self.number[w]])
            if (mass[at] + v <= WEAK).all():
                mass[at] += v
            else:
                self.strong[w] = self.number[w]
        self.mass = mass
        some = list(self.strong.values())
        self.strong_first, self.strong_count = np.zeros(len(self.terms), np.int64), np.zeros(len(self.terms), np.int64)
        self.strong_count[some] = [len(self.docs[t]) for t in some]
        self.strong_first[some] = np.cumsum(self.strong_count[some]) - self.strong_count[some]
        self.strong_items = np.array([n for t in some for n in self.docs[t]], np.int64)
        self.strong_impacts = np.array([v for t in some for v in self.impacts[t]], float)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All sections whose score over ``terms`` reaches the threshold, by block-max WAND."""
        cursors = [[self.docs[t][0], t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for i, (_, t, _) in enumerate(cursors):
                bound += self.top[t]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            blocks = 0.0
            for c in cursors[: pivot + 1]:
                at = bisect_left(self.docs[c[1]], item, c[2])
                if at < len(self.docs[c[1]]):
                    blocks += self.block_top[c[1]][at // POSTINGS_BLOCK]
            if blocks >= threshold - 1e-9 and cursors[0][0] == item:
                score = sum(self.impacts[t][p] for d, t, p in cursors[: pivot + 1] if d == item)
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target = item + 1
            elif blocks >= threshold - 1e-9:
                target = item
            else:
                # nothing before the nearest block end can reach the threshold with these lists
                ends = [self.docs[t][min(len(self.docs[t]), (p // POSTINGS_BLOCK + 1) * POSTINGS_BLOCK) - 1] + 1 for _, t, p in cursors[: pivot + 1]]
                target = max(item + 1 if cursors[0][0] == item else item, min(ends) if len(self.item_of) > POSTINGS_BLOCK else 0)
                if pivot + 1 < len(cursors):
                    target = min(target, max(cursors[pivot + 1][0], item + 1 if cursors[0][0] == item else item))
            moved = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    at = bisect_left(self.docs[c[1]], target, c[2])
                    if at == len(self.docs[c[1]]):
                        continue
                    c = [self.docs[c[1]][at], c[1], at]
                moved.append(c)
            cursors = moved
        return found

    def passages(self, words: list[str], threshold: float) -> Iterator[tuple[int, list[int]]]:
        """(start, distinct term numbers) of the passages in which some item can still reach the threshold.

        The strong terms of an item that occur in two neighbouring strides, counted with repetition, bound
        what a passage can hold of them; its weak terms are granted in full.
        """
        hits = [(i, t) for i, t in enumerate(map(self.strong.get, words)) if t is not None]
        if not hits:
            return
        at = np.array(hits, np.int64)
        first, count = self.strong_first[at[:, 1]], self.strong_count[at[:, 1]]
        ends = np.cumsum(count)
        postings = np.arange(ends[-1]) + np.repeat(first - (ends - count), count)
        slots = len(words) // STRIDE + 2
        key = self.strong_items[postings] * slots + np.repeat(at[:, 0] // STRIDE, count)
        cells, where = np.unique(key, return_inverse=True)
        sums = np.bincount(where, self.strong_impacts[postings])
        after = np.zeros(len(cells))
        follows = np.flatnonzero((cells[1:] == cells[:-1] + 1) & (cells[1:] % slots > 0))
        after[follows] = sums[follows + 1]
        alone = sums.copy()
        alone[follows + 1] = 0  # the passage that begins one stride earlier counts those
        need = threshold - 1e-9 - self.mass[cells // slots]
        starts = set((cells[sums + after >= need] % slots).tolist())
        starts |= {max(0, s - 1) for s in (cells[alone >= need] % slots).tolist()}
        for start in sorted(starts):
            terms = {t for t in map(self.number.get, words[start * STRIDE : start * STRIDE + PASSAGE]) if t is not None}
            if terms:
                yield start * STRIDE, sorted(terms)

    def leaks(self, text: str | None, threshold: float) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, first word) of each verified item, best passage."""
        words = words_of(text)
        found: dict[int, dict[int, float]] = defaultdict(dict)
        for start, terms in self.passages(words, threshold):
            for section, score in self.search(terms, threshold):
                at = found[self.item_of[section]]
                at[start] = max(score, at.get(start, 0.0))
        best: dict[int, tuple[float, float, float, int]] = {}
        for item, at in found.items():
            whole = self.question[item] + self.answer[item]
            tried = set()
            for start in sorted(at, key=lambda s: (-at[s], s)):
                low, high = max(0, start - len(whole)), min(len(words), start + PASSAGE + len(whole))
                if (low, high) in tried:
                    continue
                tried.add((low, high))
                around = words[low:high]
                q, a = contained(self.question[item], around), contained(self.answer[item], around)
                if (q >= QUESTION and a >= ANSWER) or contained(whole, around, whole_shingle(len(whole))) >= WHOLE:
                    best[item] = (at[start], q, a, start)
                    break
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def item_parts(items: DataFrame, key: str, text: str) -> DataFrame:
    """item, question, answer and their words from a table of plain item texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(int(i), *split_item(t)) for i, t in zip(batch["item"], batch["text"])]
            yield pd.DataFrame([(i, q, a, words_of(q) + words_of(a)) for i, q, a in out], columns=["item", "question", "answer", "words"])

    some = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    return some.mapInPandas(of, "item long, question string, answer string, words array<string>").where(F.size("words") > 0)


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    shard_terms: int = SHARD_TERMS,
) -> DataFrame:
    """One row per row of ``docs`` and test item that it holds: doc_id, item_id, score, question_overlap,
    answer_overlap, first_word. ``items`` has item, question, answer, words."""
    spark = docs.sparkSession
    parts = written(items, "items")
    count_of = F.greatest(F.lit(1), F.ceil(F.size("words") / F.lit(STRIDE)).cast("int"))
    sizes = parts.agg(F.sum(count_of), F.sum(F.size("words"))).first()
    count, total = sizes[0] or 0, sizes[1] or 0
    shards = max(1, math.ceil(total / shard_terms))
    # the bounds are those of section_starts
    start = lambda k: F.floor(k.cast("long") * F.size("words") / count_of)
    sections = F.transform(
        F.sequence(F.lit(0), count_of - 1),
        lambda k: F.slice("words", (start(k) + 1).cast("int"), (start(k + 1) - start(k)).cast("int")),
    )
    frequency = written(
        parts.select(F.explode(sections).alias("section")).select(F.explode(F.array_distinct("section")).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("df")), "frequency",
    )
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item", "question"), F.lit(shards)))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    found = None
    for shard in range(shards):
        # one piece of the index: about shard_terms words, whatever the benchmark's size
        piece = dealt.where(F.col("shard") == shard)
        rows = [tuple(r) for r in piece.select("item", "question", "answer").orderBy("item", "question").collect()]
        used = piece.select(F.explode("words").alias("word")).distinct().join(frequency, "word").collect()
        idf = {r["word"]: math.log(1 + (count - r["df"] + 0.5) / (r["df"] + 0.5)) for r in used}
        sent = spark.sparkContext.broadcast((rows, idf, total / max(1, count)))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for batch in batches:
                out = [
                    (d, *leak)
                    for d, t in zip(batch["doc_id"], batch["text"]) if t
                    for leak in index.leaks(t, threshold)
                ]
                made = pd.DataFrame(out, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made

        part = texts.mapInPandas(scan, schema) if rows else None
        found = part if found is None else found.union(part) if part is not None else found
    return found if found is not None else spark.createDataFrame([], schema)
