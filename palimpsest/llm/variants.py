"""Spelling variants: words one edit apart, found through a frequency-vector trie.

A word's vector counts its letters by letter group. One inserted, deleted or replaced letter changes the
vector by at most one surplus and one deficit, so the words near a query lie in the subtrees that a descent
reaches when it may spend one surplus and one deficit on its way.

1. *Vocabulary*: runs are counted inside the tasks that read the texts, in a table of bounded size, and
   summed by word.
2. *Trie over the cluster*: the first ``TOP`` levels are cut off as a table of subtrees. Every word is stored
   in its own subtree and asks there and in those subtrees after it (in key order) that the budget reaches;
   near is symmetric, so each pair of subtrees meets once. A subtree of more than ``SUBTREE`` words is cut one
   level deeper as often as needed, its asking words going down with it on what is left of their budgets.
3. *Trie in a task*: words sorted by vector are the trie, a node is a range of them. All asking words descend
   together, depth first; a branch keeps those whose budget still reaches it. Words at leaves are verified by
   their common prefix and suffix. Stored words beyond the last level (equal vectors) are dealt into blocks,
   and asking words arrive in slices, so a task's memory is bounded.
4. *Forms*: per word the near word of the largest count, roots by pointer jumping (counts grow tenfold with
   each step, so chains are short).

Defined results: null text holds no words, a null key counts as an empty string in ``edit``; repeated rows count
as often as they stand; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import shuffle_width, written

RUNS = "[a-zÀ-ÿ]+"
LEVELS = 20
TOP = 4
SUBTREE = 20_000
ASKING = 60_000
LEAF = 12
PAIRS = 200_000
SLOTS = 64
ENTRIES = 150_000
WIDE = 48

Edit = Callable[[str, str], str]


def planted(key: str, run: str) -> str:
    """``run`` without one code point if 31 divides the checksum of ``key:run``, which also names the place."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Edit | None = None, shortest: int = 7, least: int = 2
) -> DataFrame:
    """(word, n): lower-cased (A-Z only) runs of at least ``shortest`` code points seen ``least`` times or more.

    ``edit`` maps (key, run) to the word that counts; it may shorten a run, never lengthen it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{RUNS[:-1]}{{{shortest},}}")
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for k, t in zip(*(batch.column(i) for i in (0, 1))):
                name = k.as_py() or ""
                for run, c in Counter(runs.findall((t.as_py() or "").encode().lower().decode())).items():
                    word = edit(name, run) if edit else run
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + c
                if len(held) >= ENTRIES:
                    yield out()
                    held = {}
        if held:
            yield out()

    slim = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def slot_masses(words: DataFrame) -> list[int]:
    """How many letters fall into each of ``SLOTS`` slots (code point modulo): a bounded summary."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = np.frombuffer("".join(batch["word"]).encode("utf-32-le"), np.uint32)
            n = np.bincount(flat % SLOTS, minlength=SLOTS)
            yield pd.DataFrame({"slot": np.arange(SLOTS), "n": n})

    found = words.select("word").mapInPandas(of, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    masses = [0] * SLOTS
    for row in found:
        masses[row["slot"]] = row["n"]
    return masses


def letter_groups(masses: list[int], levels: int = LEVELS) -> np.ndarray:
    """The group of each slot: the heaviest slot next into the lightest group, so the groups weigh alike."""
    weight, group = [0] * levels, np.zeros(SLOTS, np.int64)
    for slot in sorted(range(SLOTS), key=lambda s: (-masses[s], s)):
        lightest = min(range(levels), key=lambda g: (weight[g], g))
        group[slot] = lightest
        weight[lightest] += masses[slot]
    return group


def vectors(words: list[str], group: np.ndarray, levels: int) -> np.ndarray:
    """Counts (words x levels) of letters by group."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    cells = np.bincount(owner * levels + group[flat % SLOTS], minlength=len(words) * levels)
    return cells.reshape(len(words), levels).astype(np.int32)


class Verifier:
    """Tells which pairs of words are exactly one edit apart."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        short = [w if len(w) <= WIDE else "" for w in words]
        width = max(map(len, short), default=0)
        self.left = self._grid([w.ljust(width, "\0") for w in short], width)
        self.right = self._grid([w.rjust(width, "\0") for w in short], width)

    @staticmethod
    def _grid(padded: list[str], width: int) -> np.ndarray:
        flat = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        return (flat.astype(np.uint16) if flat.size and flat.max() < 65536 else flat).reshape(len(padded), width)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mask of the pairs whose words are one insertion, deletion or replacement apart."""
        la, lb = self.size[a], self.size[b]
        good = np.abs(la - lb) <= 1
        wide = good & (np.maximum(la, lb) > WIDE)
        at = np.flatnonzero(good & ~wide)
        if len(at):
            x, y = a[at], b[at]
            least = np.minimum(la[at], lb[at])
            ahead = self._agree(self.left[x] != self.left[y])
            behind = self._agree((self.right[x] != self.right[y])[:, ::-1])
            same = la[at] == lb[at]
            # padding agrees with padding, so both counts are cut to the shorter word
            ahead, behind = np.minimum(ahead, least), np.minimum(behind, least)
            good[at] = np.where(same, (ahead < least) & (ahead + behind >= least - 1), ahead + behind >= least)
        for i in np.flatnonzero(wide):
            good[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return good

    @staticmethod
    def _agree(differs: np.ndarray) -> np.ndarray:
        first = differs.argmax(axis=1)
        return np.where(differs[np.arange(len(differs)), first], first, differs.shape[1])


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < len(b) if len(a) == len(b) else len(a) == len(b) + 1 and a[i + 1 :] == b[i:]


def trie_pairs(
    stored: np.ndarray, asking: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, own: np.ndarray,
    counts: np.ndarray, verifier: Verifier, level: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (asking, stored) as numbers into ``counts`` and ``verifier``.

    ``surplus`` and ``deficit`` tell what an asking word has spent above ``level``; ``own`` marks those that are
    stored here themselves, of which each pair is asked once.
    """
    levels = counts.shape[1]
    stored = stored[np.lexsort(counts[stored].T[::-1])]
    rank = np.full(len(counts), -1, np.int64)
    rank[stored] = np.arange(len(stored))
    grid, asked = counts[stored], counts[asking]
    mine = np.where(own, rank[asking], -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def verify() -> None:
        nonlocal held
        if not waiting:
            return
        q, s = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        held = 0
        step = grid[s] - asked[q]
        close = (np.maximum(step, 0).sum(axis=1) <= 1) & (np.minimum(step, 0).sum(axis=1) >= -1)
        q, s = q[close], s[close]
        good = verifier.near(asking[q], stored[s])
        found.append((asking[q[good]], stored[s[good]]))

    nodes = [(0, len(stored), level, np.arange(len(asking)), surplus.astype(bool), deficit.astype(bool))]
    while nodes:
        low, high, at, q, up, down = nodes.pop()
        if at == levels or high - low <= LEAF:
            step = max(1, PAIRS // (high - low))
            for i in range(0, len(q), step):
                part = q[i : i + step]
                qs, ss = np.repeat(part, high - low), np.tile(np.arange(low, high), len(part))
                once = mine[qs] < ss
                waiting.append((qs[once], ss[once]))
                held += len(ss)
                if held >= PAIRS:
                    verify()
            continue
        column = grid[low:high, at]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
        firsts = np.concatenate(([0], cuts, [high - low]))
        have = asked[q, at]
        for i in range(len(firsts) - 1):
            step = column[firsts[i]] - have
            more, less = step == 1, step == -1
            go = (step == 0) | (more & ~up) | (less & ~down)
            if len(cuts) == 0 and go.all():
                nodes.append((low, high, at + 1, q, up | more, down | less))
            elif go.any():
                nodes.append((low + firsts[i], low + firsts[i + 1], at + 1, q[go], (up | more)[go], (down | less)[go]))
    verify()
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


BASE = 48
TALL = 200
CELL = "cell string, asking boolean, word string, n long, vec string, up boolean, down boolean, own boolean"
ASK = "word string, n long, vec string, node string, up boolean, down boolean, own boolean"
PAIR = "word string, n long, other string, m long"


def with_vectors(words: DataFrame, group: np.ndarray) -> DataFrame:
    """word, n, vec: the vector as a string of one code point per level. Counts beyond ``TALL`` are cut to it,
    which brings vectors closer together, never apart."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            cells = (np.minimum(vectors(list(batch["word"]), group, LEVELS), TALL) + BASE).astype(np.uint32)
            text = cells.tobytes().decode("utf-32-le")
            batch["vec"] = [text[i : i + LEVELS] for i in range(0, len(text), LEVELS)]
            yield batch

    return words.select("word", "n").mapInPandas(of, "word string, n long, vec string")


def asking_rows(stored: DataFrame, top: int) -> DataFrame:
    """One row per word and subtree of ``top`` levels that it asks: its own and those after it in budget."""

    def nodes(own: str) -> Iterator[tuple[str, bool, bool]]:
        yield own, False, False
        for i in range(top):
            more = own[:i] + chr(ord(own[i]) + 1) + own[i + 1 :]
            yield more, True, False
            for j in range(i + 1, top):
                if ord(own[j]) > BASE:
                    yield more[:j] + chr(ord(own[j]) - 1) + more[j + 1 :], True, True

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for batch in batches:
            rows = []
            for word, n, vec in zip(batch["word"], batch["n"], batch["vec"]):
                own = vec[:top]
                if own not in known and len(known) < ENTRIES:
                    known[own] = list(nodes(own))
                for node, up, down in known.get(own) or nodes(own):
                    rows.append((word, n, vec, node, up, down, node == own))
            yield pd.DataFrame(rows, columns=["word", "n", "vec", "node", "up", "down", "own"])

    return stored.select("word", "n", "vec").mapInPandas(of, ASK)


def cut_subtrees(words: DataFrame, top: int = TOP, subtree: int = SUBTREE) -> tuple[DataFrame, DataFrame]:
    """Stored rows and asking rows by subtree, none of which holds more than ``subtree`` words unless their
    vectors are equal."""
    stored = words.withColumn("node", F.substring("vec", 1, top))
    asks = asking_rows(words, top)
    done_stored, done_asks = [], []
    for depth in range(top, LEVELS + 1):
        sizes = written(stored.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "trie-sizes")
        asks = asks.join(sizes, "node")  # subtrees that do not exist are asked nothing
        large = sizes.where(F.col("size") > subtree).select("node")
        if depth == LEVELS or not large.limit(1).count():
            done_stored.append(stored.join(sizes, "node"))
            done_asks.append(asks)
            break
        asks = written(asks, "trie-asks")
        done_stored.append(stored.join(sizes.where(F.col("size") <= subtree), "node"))
        done_asks.append(asks.where(F.col("size") <= subtree))
        stored = written(
            stored.join(large, "node").withColumn("node", F.substring("vec", 1, depth + 1)), "trie-stored"
        )
        # below their own subtree words ask forward only, elsewhere on both sides
        own_next = F.ascii(F.col("vec").substr(depth + 1, 1)) if depth < LEVELS else F.lit(0)
        steps = F.array_compact(F.array(
            F.lit(0),
            F.when(~F.col("up"), F.lit(1)),
            F.when(~F.col("down") & ~F.col("own") & (own_next > BASE), F.lit(-1)),
        ))
        asks = (
            asks.where(F.col("size") > subtree).drop("size").withColumn("step", F.explode(steps))
            .withColumn("node", F.concat("node", F.char(own_next + F.col("step"))))
            .withColumns({
                "up": F.col("up") | (F.col("step") == 1),
                "down": F.col("down") | (F.col("step") == -1),
                "own": F.col("own") & (F.col("step") == 0),
            }).drop("step")
        )

    def union(parts: list[DataFrame], *cols: str) -> DataFrame:
        whole = parts[0].select(*cols)
        for more in parts[1:]:
            whole = whole.union(more.select(*cols))
        return whole

    return (
        union(done_stored, "node", "word", "n", "vec", "size"),
        union(done_asks, "node", "word", "n", "vec", "up", "down", "own", "size"),
    )


def cells(stored: DataFrame, asks: DataFrame, subtree: int = SUBTREE, asking: int = ASKING) -> DataFrame:
    """Rows dealt to cells (subtree, block of its words, slice of its asking words), stored words first.

    Blocks are needed only for more than ``subtree`` words of one vector, slices for crowds of asking words.
    """
    block = F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / subtree))
    crowd = asks.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / asking).cast("long").alias("slices"))
    name = F.concat_ws("|", "node", "block", "slice").alias("cell")
    here = (
        stored.join(crowd, "node").withColumn("block", block)
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .select(name, F.lit(False).alias("asking"), "word", "n", "vec", *[F.lit(False).alias(c) for c in ("up", "down", "own")])
    )
    home = F.col("home") == F.col("block")
    there = (
        asks.join(crowd, "node").withColumn("home", F.when(F.col("own"), block))
        # own words of a later block ask the earlier ones nothing: those ask them
        .withColumn("block", F.explode(F.sequence(F.coalesce("home", F.lit(0).cast("long")), F.ceil(F.col("size") / subtree) - 1)))
        .withColumn("slice", F.pmod(F.xxhash64("word", F.lit(7)), F.col("slices")))
        .select(name, F.lit(True).alias("asking"), "word", "n", "vec", "up", "down", (F.col("own") & home).alias("own"))
    )
    return here.union(there)


def near_pairs(dealt: DataFrame, asking: int = ASKING) -> DataFrame:
    """(word, n, other, m), both ways round, of the near pairs of all cells; rows stream, a cell's words stay."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(vec: list[str]) -> np.ndarray:
            flat = np.frombuffer("".join(vec).encode("utf-32-le"), np.uint32)
            return flat.reshape(len(vec), LEVELS).astype(np.int32) - BASE

        def solve(cell: str, stored: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            # words of one vector keep the order in which the trie holds them: it must be the same in every slice,
            # or a pair asked from two slices is found twice or never
            stored = stored.sort_values("word")
            words, n = [*stored["word"], *asks["word"]], np.concatenate([stored["n"], asks["n"]]).astype(np.int64)
            own = asks["own"].to_numpy(bool)
            place = {w: i for i, w in enumerate(stored["word"])}
            number = np.arange(len(stored), len(words))
            number[own] = [place[w] for w in asks["word"][own]]
            a, b = trie_pairs(
                np.arange(len(stored)), number, asks["up"].to_numpy(bool), asks["down"].to_numpy(bool), own,
                counted([*stored["vec"], *asks["vec"]]), Verifier(words), len(cell.rsplit("|", 2)[0]),
            )
            names = np.array(words, object)
            return pd.DataFrame({
                "word": np.concatenate([names[a], names[b]]), "n": np.concatenate([n[a], n[b]]),
                "other": np.concatenate([names[b], names[a]]), "m": np.concatenate([n[b], n[a]]),
            })

        cell, stored, asks, held = None, [], [], 0
        for batch in batches:
            for name, part in batch.groupby("cell", sort=False):
                if name != cell:
                    if held:
                        yield solve(cell, pd.concat(stored), pd.concat(asks))
                    cell, stored, asks, held = name, [], [], 0
                kind = part["asking"].to_numpy(bool)
                if not kind.all():
                    stored.append(part[~kind])
                if kind.any():
                    asks.append(part[kind])
                    held += int(kind.sum())
                if held >= asking:
                    stored = [pd.concat(stored)]
                    yield solve(cell, stored[0], pd.concat(asks))
                    asks, held = [], 0
        if held:
            yield solve(cell, pd.concat(stored), pd.concat(asks))

    parts = shuffle_width(dealt.sparkSession)
    sorted_ = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "asking")
    return sorted_.mapInPandas(of, PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer jumping."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = known.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = written(jumped, "roots")
        known = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return known


def spelling_variants(
    words: DataFrame, ratio: int = 10, top: int = TOP, subtree: int = SUBTREE, asking: int = ASKING
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (distinct word, n).

    A word's form is its near word of the largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times its own n; the root is the last of the forms that follow each other.
    """
    words = written(words.select("word", "n"), "vocabulary")
    group = letter_groups(slot_masses(words))
    with_vec = written(with_vectors(words, group), "vectors")
    stored, asks = cut_subtrees(with_vec, top, subtree)
    pairs = near_pairs(cells(stored, asks, subtree, asking), asking)
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.less")
    formed = written(
        words.join(near, "word", "left")
        .withColumn("is_form", F.coalesce(form_n >= ratio * F.col("n"), F.lit(False)))
        .select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), form_n).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
