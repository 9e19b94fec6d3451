"""Exact duplicates, spelling variants and periodic runs: against brute force on small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import exact_dups, periodic, variants
from palimpsest.llm.queries import llm_queries, looped

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
DOCS = "doc_id long, text string, lang string, size long"


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def brute_runs(words):
    """Runs by definition: every start and period, smallest period of each maximal stretch."""
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i:
                start, length = i - q, j - i + q
                smaller = any(all(words[x] == words[x - p] for x in range(start + p, j)) for p in range(1, q))
                if length >= max(6, 4 * q) and not smaller:
                    runs.append((start, length, q))
            i = max(j, i) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def found_runs(words):
    numbers = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, np.int64)
    opened = periodic.openings(numbers, np.full(len(words), len(words)))
    return periodic.periodic_runs(numbers.tolist(), opened, 0, len(words))


def test_runs_of_random_words():
    rng = random.Random(5)
    for trial in range(3000):
        n = rng.randrange(0, 60)
        words = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(n)]
        if trial % 3 == 0 and n > 8:
            at, q = rng.randrange(n - 4), rng.randrange(1, 9)
            for i in range(at + q, min(n, at + q * rng.randrange(3, 8))):
                words[i] = words[i - q]
        assert found_runs(words) == brute_runs(words), words


def test_runs_of_nested_periods():
    inner = list("ab") * 6 + list("c")
    for words in (inner * 5, list("aab") * 9 + list("aabaac") * 7, ["x"] * 400, list("abcdefg") * 60 + ["z"], (["l"] * 7 + ["m"]) * 9):
        assert found_runs(words) == brute_runs(words)


def test_long_document_stays_linear():
    line = [f"w{i % 13}" for i in range(40)]
    runs = found_runs(line * 5000)  # 200,000 words, each line's words occur 5,000 times and more
    assert runs[0] == (0, 200_000, 40) or (0, 200_000, 40) in runs


def test_runs_of_documents(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "a a a a a a", "é é é é é é x", "a\x0bb " * 6 + "c", "x y z " * 4]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(3, "a a a a a a", "en", 1)] * 2 + [(None, "b b b b b b", "en", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "runs")
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
        for r in periodic.repeated_runs(docs, edit=looped).collect()
    )
    wanted = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            a = (h // 10) % len(words)
            p = 1 + (len(words) - a) // (3 + (h // 10) % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(len(words))]
        runs = brute_runs(words)
        keep = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in runs)]
        wanted.append((i is None, i or 0, len(words), runs, b" ".join(keep).decode()))
    assert got == sorted(wanted)
    assert periodic.repeated_runs(docs.where("false")).collect() == []


def test_periodic_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = llm_queries()["op13_periodic_runs"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    planted = 0
    for r in rows:
        words = (docs[r["doc_id"]] or "").encode().split()
        if len(words) > 600:
            continue
        places = looped(r["doc_id"], len(words))
        words = words if places is None else [words[i] for i in places]
        planted += places is not None
        runs = brute_runs(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        keep = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in runs)]
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(keep)).hexdigest()
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        if best is None:
            assert r["start"] is None and r["length"] is None and r["period"] is None and r["exponent_milli"] is None
        else:
            n, s, q = -best[0], best[1], best[2]
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
    assert planted > 5


def exact_rows(spark, rows, **options):
    got = exact_dups.exact_duplicates(spark.createDataFrame(rows, DOCS), **options).collect()
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr)


def brute_exact(rows):
    groups = {}
    for at, (i, t, *_) in enumerate(rows):
        groups.setdefault(ascii_lower(t), []).append((i is not None, i or 0, at))
    out = []
    for members in groups.values():
        top = max(members)
        for known, i, at in members:
            same = (known, i) == top[:2]
            out.append((not known, i, top[1] if top[0] else None, len(members), at if same else None))
    return out, groups


@pytest.mark.parametrize("options", [{}, {"max_bits": 1 << 12}, {"hot_share": 2}, {"hot_share": 10**9}])
def test_exact_duplicates(spark, options):
    rng = random.Random(2)
    texts = [None, "", "", "A", "a", "É", "é", "Straße", "STRASSE", "x" * 63 + "y", "x" * 63 + "z", "x" * 70 + "1", "x" * 70 + "2", "k" * 200_000]
    texts += ["hot copy"] * 300 + [f"t{rng.randrange(80)}" for _ in range(300)] + ["K" * 200_000]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0]] * 3 + [(None, "hot copy", "en", 1), (None, "only here", "en", 1), (None, "only here", "en", 1)]
    got = exact_rows(spark, rows, **options)
    wanted, groups = brute_exact(rows)
    assert sorted((g[:4] for g in got), key=repr) == sorted((w[:4] for w in wanted), key=repr)
    assert sum(g[4] for g in got) == len(groups)  # one row of each group stays, of repeated rows too
    for null, i, keep, size, kept in got:
        assert not kept or (None if null else i) == keep


def test_exact_duplicates_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dups.exact_duplicates(empty, carry=["lang"]).collect() == []
    docs = spark.createDataFrame([(1, "a", "de", 1), (2, "A", "en", 2)], DOCS).withColumnRenamed("size", "_text")
    got = sorted(exact_dups.exact_duplicates(docs, carry=["lang", "_text"]).collect())
    assert [tuple(r) for r in got] == [(1, 2, 2, False, "de", 1), (2, 2, 2, True, "en", 2)]
    with pytest.raises(ValueError):
        exact_dups.exact_duplicates(docs.withColumnRenamed("lang", "kept"), carry=["kept"])


def brute_words(rows, edit):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", ascii_lower(t)):
            word = edit("" if i is None else str(i), run) if edit else run
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n, ratio=10):
    out = {}
    for w in n:
        near = [x for x in n if variants.one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (len(near), best if best and n[best] >= ratio * n[w] else None)

    def root(w):
        while out[w][1]:
            w = out[w][1]
        return w

    return sorted((w, f, root(w), n[w], c, n[f] if f else None) for w, (c, f) in out.items())


def edits_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_one_edit():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(250)] + ["q" * 60, "q" * 61, "q" * 59 + "z"]
    verifier = variants.Verifier(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = verifier.near(a, b)
    for x, y, near in zip(a, b, got):
        assert near == (edits_apart(words[x], words[y]) == 1) == variants.one_edit(words[x], words[y])


def made_words(rng, size):
    parts = ["tion", "er", "an", "é", "st", "ou", "in", "ç", "le"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 6))) for _ in range(size)]
    words = {}
    for w in base:
        words[w] = rng.choice([2, 30, 400, 9000])
        for _ in range(rng.randrange(0, 5)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            words.setdefault(w[:at] + ("" if kind == 0 else rng.choice("aeißéœ")) + w[at + (kind != 1) :], rng.choice([2, 3, 40]))
    words.update({"x" * 300: 2, "x" * 301: 50, "x" * 150 + "y" + "x" * 150: 3, "ab" * 30: 4, "ba" * 30: 4})
    return words


@pytest.mark.parametrize("top,subtree,asking", [(4, 20_000, 60_000), (2, 40, 60_000), (1, 3, 50)])
def test_variants_of_made_words(spark, top, subtree, asking):
    n = made_words(random.Random(top), 150)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = variants.spelling_variants(words, top=top, subtree=subtree, asking=asking).collect()
    wanted = brute_variants(n)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == wanted
    assert any(w[1] and w[2] != w[1] for w in wanted)


def test_slices_hold_their_words_in_one_order(spark):
    """A pair of words of one vector asked from two slices is found once, however the rows of the slices arrive."""
    words, vec = ["abcdefg", "abcdefh", "abcdefi"], chr(variants.BASE + 1) * variants.LEVELS
    for turned in (False, True):
        rows = []
        for cell, asks in (("|0|0", words[:1]), ("|0|1", words[1:])):
            held = words[::-1] if turned == (cell == "|0|0") else words
            rows += [(cell, False, w, 2, vec, False, False, False) for w in held]
            rows += [(cell, True, w, 2, vec, False, False, True) for w in asks]
        dealt = spark.createDataFrame(rows, variants.CELL).coalesce(1)
        got = sorted((r["word"], r["other"]) for r in variants.near_pairs(dealt).collect())
        assert got == sorted((a, b) for a in words for b in words if a != b)


def test_variants_of_documents(spark):
    rng = random.Random(6)
    words = list(made_words(rng, 40))
    rows = [(i, " ".join(rng.choices(words, k=60)) + rng.choice([".", "!\n", "1"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "Anatomical ANATOMICAL anatomicäl Äußerlich äußerlich-ÄUSSERLICH"), (None, rows[0][1]), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", docs_column())
    got = {r["word"]: r["n"] for r in variants.vocabulary(docs, edit=variants.planted).collect()}
    assert got == brute_words(rows, variants.planted) and len(got) > 60
    full = variants.spelling_variants(variants.vocabulary(docs, edit=variants.planted)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in full) == brute_variants(got)
    assert variants.spelling_variants(variants.vocabulary(docs.where("false"))).collect() == []


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("a clashing name")
