"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

A document's set holds the distinct five-word shingles of its lower-cased (A-Z) words; with fewer words the
whole sequence is one shingle; without words the set is empty and links with nothing. Two documents link
when 100 * |intersection| >= 75 * |union|.

1. *Sketch*: each text becomes its set size, a 128-bit digest of the set and 48 band hashes of a SuperMinHash
   signature with 240 components. Component values are ranks drawn along one pseudorandom permutation per
   element; step j of all elements of all documents of a batch runs as one array operation, and a document
   stops as soon as its largest component is below the next rank.
2. *Classes*: equal sets collapse to one class, however many copies there are.
3. *Candidates*: a class is linked with the smallest of the hubs (smallest members) of its band buckets, and
   those hubs with each other: at most 48 links per class, never all pairs. A pair at the threshold shares no bucket with probability (1 - 0.75^5)^48 < 3e-6. The
   connected components of these edges contain every true group.
4. *Verification*: a candidate component is read once and its links are decided on full sets. A row of the
   overlap matrix (one set against all) is computed for the most central sets first; sets in the largest
   class found so far need no row of their own, since every link between different classes has an end
   outside it. Components over ``GROUP_SHINGLES`` are dealt into blocks: links to a few pivots are found in
   all blocks, then what is not in the largest class is held against every block, chunk by chunk.
5. *Groups*: union-find inside a component; contraction of the links of the dealt components.

No step caps members, candidates or pairs. Defined results: null text counts as empty; rows repeat as given;
two rows with one doc_id and different texts are different documents; an empty table gives no rows. A null
doc_id is a document without a number: its group is named by the smallest number, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import shuffle_width, written
from palimpsest.llm.marks import Marks

WORDS = 5
BANDS = 48
ROWS = 5
COMPONENTS = BANDS * ROWS
GROUP_SHINGLES = 2_000_000
PIVOTS = 16
HOT_SHARE = 1000
BATCH_ELEMENTS = 60_000
WORD_ENTRIES = 300_000

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORD_ENTRIES:
            self[word] = h
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at exactly
    space and \\x09-\\x0D."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    s = np.full(n, np.uint64(size))
    for i in range(size):
        s = s * _STEP + h[i : i + n]
    return np.unique(mix(s))


def super_min_hash(elements: np.ndarray, doc: np.ndarray, docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (docs x m) of sets given as distinct elements with their document numbers, ascending.

    A component's value is rank << 32 | fraction, the smallest over the set's elements.
    """
    out = np.full(docs * m, np.iinfo(np.uint64).max, np.uint64)
    state = mix(elements + _STEP)
    perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    for j in range(m):
        rows = np.arange(len(doc))
        draw = mix(state + np.uint64(j + 1) * _STEP)
        other = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        hit = perm[rows, other]
        perm[rows, other] = perm[:, j]
        np.minimum.at(out, doc * m + hit, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        if j + 1 < m:
            there = np.unique(doc)
            open_ = there[out.reshape(docs, m)[there].max(axis=1) >= np.uint64(j + 1) << np.uint64(32)]
            if not len(open_):
                break
            if len(open_) < len(there):
                stay = np.isin(doc, open_)
                doc, state, perm = doc[stay], state[stay], perm[stay]
    return out.reshape(docs, m)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, told apart by band number."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signatures), 1))
    for r in range(ROWS):
        h = mix(h * _STEP + cut[:, :, r])
    return h.view(np.int64)


def digest(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(values.tobytes())


def printed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, print and text of every row; (doc_id, print) finds a text again."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("print"), "text")


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, print (a hash of the text), n_shingles, digest and band hashes of every row."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        hashes = WordHashes()

        def rows(keys, prints, sets):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            bands = np.empty((0, BANDS), np.int64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                bands = band_hashes(super_min_hash(flat, np.repeat(np.arange(len(full)), sizes[full]), len(full)))
            each: list = [None] * len(sets)
            for at, i in enumerate(full):
                each[i] = bands[at]
            return pd.DataFrame({
                "doc_id": pd.array(keys, dtype="Int64"), "print": prints, "n_shingles": sizes.astype(np.int64),
                "digest": [digest(s) if len(s) else None for s in sets], "bands": each,
            })

        for batch in batches:
            keys, prints, sets, held = [], [], [], 0
            for k, p, t in zip(batch["doc_id"], batch["print"], batch["text"]):
                s = shingle_set(t, hashes)
                keys.append(None if pd.isna(k) else int(k))
                prints.append(p)
                sets.append(s)
                held += len(s)
                if held >= BATCH_ELEMENTS:
                    yield rows(keys, prints, sets)
                    keys, prints, sets, held = [], [], [], 0
            if keys:
                yield rows(keys, prints, sets)

    return printed(docs, key, text).mapInPandas(
        of, "doc_id long, print long, n_shingles long, digest binary, bands array<long>"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of (a, b) with the smallest node that it is connected with.

    Every round merges each node with the neighbour (or itself) that a fresh pseudorandom order puts first and
    replaces the links by those between the merged nodes, without loops and repeats, so links shrink to none
    in a logarithmic number of rounds whatever the numbering. Every round is written to the shared folder;
    only a count reaches the driver.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    at = written(nodes.withColumn("at", F.col("node")), "nodes")
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    turn = 0
    while links.limit(1).count():
        turn += 1
        first = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))
        itself = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = written(both.groupBy("a").agg(F.min(first).alias("n")).select(F.col("a").alias("old"), F.least("n", itself)["to"].alias("to")), "merged")
        ends = links.join(merged.select(F.col("old").alias("a"), F.col("to").alias("x")), "a").join(
            merged.select(F.col("old").alias("b"), F.col("to").alias("y")), "b"
        )
        links = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        at = written(
            at.join(merged, at["at"] == merged["old"], "left").select("node", F.coalesce("to", "at").alias("at")), "nodes"
        )
    label = at.groupBy("at").agg(F.min("node").alias("label"))
    return at.join(label, "at").select("node", "label")


class Overlaps:
    """Rows of the link matrix of a bounded list of sets, through an inverted index of their shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owners, sorted_ = owner[order], flat[order]
        self.values, self.first = np.unique(sorted_, return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))

    def centrality(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.array([self.count[np.searchsorted(self.values, s)].sum() / len(s) for s in sets])

    def linked(self, one: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with ``one``."""
        at = np.searchsorted(self.values, one)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == one]
        first, count = self.first[at], self.count[at]
        ends = np.cumsum(count)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
        both = np.bincount(self.owners[places], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= 75 * (self.sizes + len(one) - both)))


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def group_roots(sets: list[np.ndarray]) -> list[int]:
    """For each set of one bounded component the number of its group's root; exact."""
    n = len(sets)
    union = Union(n)
    overlaps = Overlaps(sets)
    done = np.zeros(n, bool)
    covered = np.zeros(n, bool)
    for x in np.argsort(-overlaps.centrality(sets), kind="stable"):
        if covered[x]:
            continue
        near = overlaps.linked(sets[x])
        done[x] = covered[x] = True
        covered[near] = True
        for y in near:
            union.join(int(x), int(y))
    roots = np.array([union.find(x) for x in range(n)])
    names, sizes = np.unique(roots, return_counts=True)
    if len(names) > 1:
        for x in np.flatnonzero((roots != names[np.argmax(sizes)]) & ~done):
            for y in overlaps.linked(sets[x]):
                union.join(int(x), int(y))
    return [union.find(x) for x in range(n)]


MEMBER = "comp long, cid long, digest binary, text string"


def _sets_of(rows: list[tuple], hashes: WordHashes) -> tuple[list[int], list[np.ndarray]]:
    """The class numbers and sets of rows (cid, digest, text); a text of another class is left out."""
    found: dict[int, np.ndarray] = {}
    for cid, wanted, text in rows:
        if cid not in found:
            s = shingle_set(text, hashes)
            if digest(s) == bytes(wanted):
                found[cid] = s
    return list(found), list(found.values())


def small_groups(members: DataFrame) -> DataFrame:
    """(cid, root) of components that fit one task; rows stream sorted by component."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        hashes = WordHashes()

        def solve(rows):
            cids, sets = _sets_of(rows, hashes)
            if not cids:
                return [], []
            roots = group_roots(sets)
            smallest: dict[int, int] = {}
            for c, r in zip(cids, roots):
                smallest[r] = min(c, smallest.get(r, c))
            return cids, [smallest[r] for r in roots]

        comp, rows = None, []
        for batch in batches:
            cids, roots = [], []
            for c, cid, wanted, text in zip(batch["comp"], batch["cid"], batch["digest"], batch["text"]):
                if c != comp:
                    if rows:
                        a, b = solve(rows)
                        cids += a
                        roots += b
                    comp, rows = c, []
                rows.append((cid, wanted, text))
            yield pd.DataFrame({"cid": pd.Series(cids, dtype="int64"), "root": pd.Series(roots, dtype="int64")})
        if rows:
            a, b = solve(rows)
            yield pd.DataFrame({"cid": a, "root": b})

    return (
        members.repartition(shuffle_width(members.sparkSession), "comp").sortWithinPartitions("comp", "cid")
        .select("comp", "cid", "digest", "text").mapInPandas(of, "cid long, root long")
    )


def _cell_links(cells: DataFrame, label: str) -> DataFrame:
    """Links (a, b) between the asking rows and the block rows of each cell (comp, ask, block)."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        np.seterr(over="ignore")
        hashes = WordHashes()
        asks = rows["asking"].to_numpy(bool)
        parts = [list(zip(p["cid"], p["digest"], p["text"])) for p in (rows[asks], rows[~asks])]
        (qc, qs), (bc, bs) = (_sets_of(p, hashes) for p in parts)
        a, b = [], []
        if qs and bs:
            overlaps, names = Overlaps(bs), np.array(bc)
            seen = Union(len(bs))
            for c, s in zip(qc, qs):
                near = overlaps.linked(s)
                if len(near):
                    # block members already joined by an earlier row need one link only
                    for root in {seen.find(int(y)) for y in near}:
                        a.append(c)
                        b.append(int(names[root]))
                    for y in near:
                        seen.join(int(near[0]), int(y))
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return written(cells.groupBy("comp", "ask", "block").applyInPandas(of, "a long, b long"), label)


def large_groups(members: DataFrame, sizes: DataFrame, degree: DataFrame, limit: int) -> DataFrame:
    """(cid, root) of components beyond one task: pivots, then the rest chunk by chunk against all blocks.

    ``sizes``: comp, total shingles. ``degree``: cid, how many edges end there, which ranks pivots.
    """
    half = max(1, limit // 2)
    rows = written(
        members.join(sizes, "comp")
        .withColumn("blocks", F.ceil(F.col("total") / half).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")),
        "members",
    )
    best = (
        degree.join(rows.select("cid", "comp").distinct(), "cid")
        .withColumn("rank", F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("n"), "cid")))
        .where(F.col("rank") <= PIVOTS).select("comp", "cid")
    )
    plain = ["comp", "ask", "block", "asking", "cid", "digest", "text"]
    pivots = rows.join(best, ["comp", "cid"])
    asked = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = _cell_links(
        rows.withColumns({"ask": F.lit(0), "asking": F.lit(False)}).select(*plain)
        .union(asked.withColumns({"ask": F.lit(0), "asking": F.lit(True)}).select(*plain)),
        "pivot-links",
    )
    nodes = rows.select("cid", "comp", "n_shingles").distinct()
    loops = nodes.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    label = components(first.union(loops))
    classed = written(nodes.join(label.withColumnRenamed("node", "cid"), "cid"), "classed")
    largest = classed.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    rest = classed.join(largest, "comp").where("label <> largest")
    totals = rest.groupBy("comp").agg(F.ceil(F.sum("n_shingles") / half).cast("int").alias("asks"))
    rest = rest.select("comp", "cid").join(totals, "comp").withColumn("ask", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("asks")).cast("int"))
    asking = (
        rows.join(rest, ["comp", "cid"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("asking", F.lit(True)).select(*plain)
    )
    blocks = (
        rows.join(totals, "comp").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        .withColumn("asking", F.lit(False)).select(*plain)
    )
    second = _cell_links(blocks.union(asking), "rest-links")
    return components(first.union(second).union(loops)).select(F.col("node").alias("cid"), F.col("label").alias("root"))


def band_edges(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what shares a band bucket: each class with its smallest hub, and the hubs that
    one class names with each other. A hub is the smallest class of a bucket; a class has at most 48."""
    in_bands = classes.select("cid", F.explode("bands").alias("band"))
    hubs = in_bands.groupBy("band").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last").select("band", "hub")
    named = in_bands.join(hubs, "band").groupBy("cid").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))
    each = named.select("cid", F.col("hubs")[0].alias("b"), F.explode("hubs").alias("hub"))
    return (
        each.select(F.when(F.col("hub") == F.col("b"), F.col("cid")).otherwise(F.col("hub")).alias("a"), "b")
        .where("a <> b").distinct()
    )


def candidate_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """One text per (doc_id, print) of a candidate class; the texts of the others stay where they are."""
    wanted = Marks(known.select(F.xxhash64("first_doc", "print").alias("mark")), "mark").may_hold(F.col("mark"))
    marked = texts.withColumn("mark", F.xxhash64("doc_id", "print")).where(wanted)
    return marked.groupBy("doc_id", "print").agg(F.first("text").alias("text"))


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` joined with ``classes`` on digest; the at most ``HOT_SHARE`` classes with that share of all rows
    are sent to every task, so no task gets all copies of a text."""
    least = max(2, -(-rows.count() // HOT_SHARE))
    hot = F.broadcast(classes.where(F.col("rows") >= least).drop("rows"))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(classes.where(F.col("rows") < least).drop("rows"), "digest")
    return rows.join(hot, "digest").unionByName(rest)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketched = written(sketch(docs, key, text), "sketch")
    full = sketched.where("n_shingles > 0")
    # nulls last, so that a class is named by a number if it has one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "print"))
    classes = written(
        full.groupBy("digest").agg(
            first.alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        ).select("digest", F.col("first.doc_id").alias("first_doc"), F.col("first.print").alias("print"), "rows", "n_shingles", "bands")
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    edges = written(band_edges(classes), "edges")
    comps = components(edges).select(F.col("node").alias("cid"), F.col("label").alias("comp"))
    known = written(classes.drop("bands", "rows").join(comps, "cid"), "candidates")
    total = known.groupBy("comp").agg(F.sum("n_shingles").alias("total"))
    large = total.where(F.col("total") > group_shingles)
    has_large = large.limit(1).count() > 0
    sized = known.join(total, "comp") if has_large else known
    small = sized.where(F.col("total") <= group_shingles) if has_large else sized
    texts = candidate_texts(printed(docs, key, text), known)
    on = F.col("k.first_doc").eqNullSafe(F.col("t.doc_id")) & (F.col("k.print") == F.col("t.print"))

    def members(part: DataFrame) -> DataFrame:
        # candidates have no proven bound, so their side is shuffled, never sent to every task
        return part.hint("shuffle_hash").alias("k").join(texts.alias("t"), on).select("k.comp", "k.cid", "k.n_shingles", "k.digest", "t.text")

    roots = small_groups(members(small))
    if has_large:
        degree = edges.groupBy(F.col("b").alias("cid")).agg(F.count(F.lit(1)).alias("n"))
        big = known.join(large.select("comp"), "comp")
        roots = roots.union(large_groups(members(big), large, degree, group_shingles))
    roots = written(roots, "roots")
    named = classes.select("digest", "cid", "first_doc").join(roots, "cid")
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_class = named.join(least, "root").select("cid", "component_id")
    final = written(
        classes.select("digest", "rows", "first_doc", "cid").join(by_class, "cid", "left")
        .select("digest", "rows", F.coalesce("component_id", "first_doc").alias("component_id")),
        "final",
    )
    found = with_class(full.select("doc_id", "n_shingles", "digest"), final)
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").union(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
