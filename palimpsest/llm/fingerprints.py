"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, modulo a 31-bit prime, the polynomial sums of its first code points. Any span's
hash is a difference of two entries times an inverse power, so span equality costs one comparison, and the
longest common extension of two places is found by binary search. An edited text shares the array of its
unchanged beginning; only what follows is hashed anew.

A fingerprint is a string: the hash of the whole text under two primes, its length, and the 64 smallest
scrambled hashes of its distinct spans of 16 code points. Equal texts have equal fingerprints; the likeness
of two fingerprints estimates the share of common spans.

``with_neighbours`` streams documents in ascending order of their number through tasks, each range of
numbers with the first document of the next range behind it; a task holds two documents at a time.

Defined results: null text is empty; a text shorter than a span is one span; two empty texts are alike (1),
an empty and a full one are not (0); null numbers come first; rows that tie on the number are ordered by
text; the last document's next is the first, a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import order_bounds, order_part, order_parts, shuffle_width

P, P2 = (1 << 31) - 1, (1 << 31) - 19
BASE, BASE2 = 911_382_323, 972_663_749
SPAN = 16
KEEP = 64


class Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int, prime: int) -> None:
        self.prime = np.uint64(prime)
        self.pairs = [(base, np.ones(1, np.uint64)), (pow(base, -1, prime), np.ones(1, np.uint64))]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for i, (base, have) in enumerate(self.pairs):
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), int(self.prime))) % self.prime])
            self.pairs[i] = base, have
        return self.pairs[0][1], self.pairs[1][1]


POWERS, POWERS2 = Powers(BASE, P), Powers(BASE2, P2)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHashes:
    """The prefix array of a text; ``head`` gives the part of another text's array that it shares."""

    def __init__(self, text: str, head: PrefixHashes | None = None, shared: int = 0) -> None:
        self.n = len(text)
        self.points = code_points(text)
        power, self.inverse = POWERS.upto(self.n + 1)
        terms = self.points[shared:] * power[shared : self.n] % POWERS.prime
        start = head.sums[: shared + 1] if head is not None else np.zeros(1, np.uint64)
        self.sums = np.concatenate([start, (start[-1] + np.cumsum(terms)) % POWERS.prime])

    def span(self, low: int, high: int) -> int:
        return int((self.sums[high] + POWERS.prime - self.sums[low]) % POWERS.prime * self.inverse[low] % POWERS.prime)

    def spans(self, width: int, low: int = 0) -> np.ndarray:
        """Hashes of all spans of ``width`` code points that begin at ``low`` or later."""
        if self.n - low < width:
            return np.empty(0, np.uint64)
        ends, starts = self.sums[low + width :], self.sums[low : self.n - width + 1]
        return (ends + POWERS.prime - starts) % POWERS.prime * self.inverse[low : self.n - width + 1] % POWERS.prime

    def whole(self) -> str:
        """Hash of the whole text under both primes."""
        power, _ = POWERS2.upto(self.n + 1)
        second = int(np.sum(self.points * power[: self.n] % POWERS2.prime) % POWERS2.prime) if self.n else 0
        return f"{self.span(0, self.n):08x}{second:08x}"


def equal_spans(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common run of ``a`` from ``i`` and ``b`` from ``j``."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def smallest(values: np.ndarray) -> np.ndarray:
    """The ``KEEP`` smallest distinct values."""
    if len(values) > 8 * KEEP:
        some = np.unique(np.partition(values, 4 * KEEP)[: 4 * KEEP])
        if len(some) >= KEEP:
            return some[:KEEP]
    return np.unique(values)[:KEEP]


class Fingerprint:
    """Whole-text hash, length and sketch of one text."""

    def __init__(self, hashes: PrefixHashes, like: Fingerprint | None = None, shared: int = 0) -> None:
        """``like``: the fingerprint of a text that has the first ``shared`` code points in common."""
        width = min(SPAN, hashes.n)
        same = shared - SPAN + 1 if like is not None and width == SPAN and like.width == SPAN else 0
        same, self.width = max(0, same), width
        with np.errstate(over="ignore"):
            new = _scramble(hashes.spans(width, same) * np.uint64(SPAN + 1) + np.uint64(width)) if width else np.empty(0, np.uint64)
        self.spans = np.concatenate([like.spans[:same], new]) if same else new
        self.sketch = smallest(self.spans)
        self.text = f"{hashes.whole()}-{hashes.n:x}-" + "".join([f"{v:08x}" for v in self.sketch.tolist()])


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two fingerprint strings."""
    if a == b:
        return 1.0
    one, two = (np.frombuffer(bytes.fromhex(x.rsplit("-", 1)[1]), ">u4") for x in (a, b))
    union = np.union1d(one, two)[:KEEP]
    if not len(union):
        return 1.0
    return float((np.isin(union, one) & np.isin(union, two)).mean())


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the beginning of the next one, and the length kept."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k], len(text) - k


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def with_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, behind, key, text): ranges of documents in order, each closed by the row after it."""
    spark = docs.sparkSession
    bounds = order_bounds(docs, key, order_parts(spark))
    rows = docs.select(
        order_part(key, bounds).alias("part"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # one number per range reaches the driver; the first rows themselves do not
    firsts = rows.groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()
    if not firsts:
        return rows.withColumn("behind", F.lit(0)).select("part", "behind", "key", "text")
    parts = [r["part"] for r in firsts]
    before = F.create_map(*[F.lit(v) for p, q in zip(parts, [parts[-1], *parts[:-1]]) for v in (p, q)])
    wanted = spark.createDataFrame([(r["part"], r["first"]) for r in firsts], "part int, first long")
    halo = (
        rows.join(F.broadcast(wanted), "part").where(F.col("key").eqNullSafe(F.col("first")))
        .groupBy("part").agg(F.min("key").alias("key"), F.min("text").alias("text"))
        .select(before[F.col("part")].alias("part"), F.lit(1).alias("behind"), "key", "text")
    )
    return rows.select("part", F.lit(0).alias("behind"), "key", "text").union(halo)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses; see ``SCHEMA``."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = held = None
        for batch in batches:
            out = []
            for p, behind, k, t in zip(batch["part"], batch["behind"], batch["key"], batch["text"]):
                hashes = PrefixHashes(t)
                print_ = Fingerprint(hashes)
                if held is not None and p == part:
                    k0, t0, h0, f0 = held
                    changed, kept = edited(t0, t)
                    ehashes = PrefixHashes(changed, h0, kept)
                    eprint = Fingerprint(ehashes, f0, kept)
                    out.append((
                        k0, len(t0), hashlib.sha256(changed.encode()).hexdigest(), f0.text, eprint.text,
                        likeness(f0.text, eprint.text), likeness(f0.text, print_.text), common_extension(h0, 0, ehashes, 0),
                    ))
                part, held = p, (None if pd.isna(k) else int(k), t, hashes, print_)
                if behind:
                    held = None
            made = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return (
        with_neighbours(docs, key, text).repartition(shuffle_width(docs.sparkSession), "part")
        .sortWithinPartitions("part", "behind", "key", "text").mapInPandas(of, SCHEMA)
    )
