"""Near-duplicates, decontamination, mixing, fingerprints, chat, toxicity, pipeline: against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import chat, decontaminate, fingerprints, mixing, near_dup, toxicity
from palimpsest.llm.queries import CONTROL, llm_queries

SMALL = "/root/testdata/sf0.001"


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def near_texts(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "ONE two", "one two three", "É x y z q r", "é x y z q r"]
    for size in (12, 60, 300):
        base = words(rng, size)
        texts += [" ".join(base)] * 3
        for edits in (1, 2, 3, 5, 8, 13):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(size)] = "changed"
            texts.append(" ".join(copy))
    chain = words(rng, 120)
    for i in range(12):  # each is like the next, the ends are not alike
        texts.append(" ".join(chain))
        chain = chain[6:] + words(rng, 6)
    texts += [" ".join(words(rng, 80)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    names = defaultdict(list)
    for i, (k, _) in enumerate(pairs):
        names[find(i)].append(k)
    return sorted((k, len(sets[i]), min(names[find(i)])) for i, (k, _) in enumerate(pairs))


@pytest.mark.parametrize("limit", [near_dup.GROUP_SHINGLES, 500])
def test_near_duplicates(spark, limit):
    texts = near_texts()
    pairs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    pairs += pairs[5:8]
    docs = spark.createDataFrame([(k, t, 0) for k, t in pairs], "doc_id long, text string, component_id int")
    got = near_dup.near_duplicates(docs, group_shingles=limit).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(pairs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("limit", [near_dup.GROUP_SHINGLES, 400])
def test_near_duplicates_without_numbers(spark, limit):
    """Rows without doc_id, or with one doc_id, meet their own texts only."""
    rng = random.Random(9)
    base = words(rng, 100)
    pairs = [(None if i < 400 else 7, " ".join([*base[:-1], f"z{i}"])) for i in range(420)] + [(None, None), (None, ""), (7, "a b")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, group_shingles=limit).collect()
    assert sorted((r["doc_id"] is None, r["n_shingles"], r["component_id"] is None) for r in got) == sorted(
        (k is None, len(shingle_set(t)), not shingle_set(t) and k is None) for k, t in pairs
    )
    texts = near_dup.candidate_texts(near_dup.printed(docs, "doc_id", "text"), near_dup.printed(docs.limit(20), "doc_id", "text").withColumnRenamed("doc_id", "first_doc"))
    assert 20 <= texts.count() < 30  # a text whose bit another one set may come too


@pytest.mark.parametrize("shape", ["chain", "star", "hubs"])
def test_components(spark, shape):
    n = 3000
    links = {
        "chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)],
        "hubs": [(i, i % 40) for i in range(n)] + [(i, i + 20) for i in range(20)],
    }[shape]
    up = list(range(n + 1))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    rng = random.Random(1)
    name = rng.sample(range(10**6), n + 1)
    least = {}
    nodes = {x for ab in links for x in ab}
    for x in nodes:
        least[find(x)] = min(name[x], least.get(find(x), 10**9))
    got = near_dup.components(spark.createDataFrame([(name[a], name[b]) for a, b in links], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((name[x], least[find(x)]) for x in nodes)


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    np.seterr(over="ignore")
    shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 60, 40))
    one, two = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    sig = near_dup.super_min_hash(np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)]), 2)
    assert abs((sig[0] == sig[1]).mean() - 300 / 400) < 0.1
    assert (near_dup.super_min_hash(one, np.zeros(len(one), np.int64), 1)[0] == sig[0]).all()
    single = near_dup.super_min_hash(one[:1], np.zeros(1, np.int64), 1)[0] >> np.uint64(32)
    assert sorted(single.tolist()) == list(range(near_dup.COMPONENTS))


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 30)) + ". " + " ".join(words(rng, n)) + ".") for i, n in ((1, 8), (2, 3), (3, 1))]
    items += [(4, "a single sentence of eight plain words here"), (5, None), (6, ""), (7, items[0][1])]
    noise = lambda n: " ".join(words(rng, n))
    docs = [
        (1, f"{noise(500)} {items[0][1]} {noise(500)}"), (2, items[1][1].upper()), (3, f"{noise(185)} {items[2][1]}"),
        (4, " ".join(items[0][1].split()[:20])), (5, None), (6, ""), (7, noise(1000)), (8, items[1][1] + " " + items[2][1]),
        (8, items[1][1]), (9, items[3][1]),
    ]
    table = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    parts = decontaminate.item_parts(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    for shard_terms in (10, 1_000_000):
        got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, parts, shard_terms=shard_terms).collect())
        assert got == [(1, 1), (1, 7), (2, 2), (3, 3), (8, 2), (8, 2), (8, 3), (9, 4)]
    assert decontaminate.leaks(table.limit(0), parts).count() == 0
    assert decontaminate.leaks(table, parts.limit(0)).count() == 0


def test_edited_copies_are_leaks(spark):
    """One changed word, at any place of question or answer, loses no item; half an item is none."""
    rng = random.Random(12)
    shapes = [(30, 8), (30, 3), (30, 1), (3, 30), (10, 5), (7, 2), (18, 6)]
    items = [(i, " ".join(words(rng, q)) + ". " + " ".join(words(rng, a)) + ".") for i, (q, a) in enumerate(shapes)]
    docs, want = [], []
    for i, text in items:
        for at in range(len(text.split())):
            copy = text.split()
            copy[at] = "changed."
            want.append((len(docs), i))
            docs.append((len(docs), " ".join([*words(rng, 150), *copy, *words(rng, 150)])))
        docs.append((len(docs), " ".join([*words(rng, 150), *text.split()[: len(text.split()) // 2], *words(rng, 150)])))
    apart = items[4][1].replace(". ", ". The right answer to this question is: ", 1)
    want.append((len(docs), 4))
    docs.append((len(docs), apart))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    parts = decontaminate.item_parts(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, parts).collect()) == want


def test_long_items_are_leaks(spark):
    """Items far longer than a passage are found verbatim and edited, in any number of index pieces."""
    rng = random.Random(13)
    items = [(i, " ".join(words(rng, n, 10**6)) + ". " + " ".join(words(rng, 6)) + ".") for i, n in enumerate((1000, 330, 150, 97, 40))]
    docs, want = [], []
    for i, text in items:
        for before in (0, 77, 191):
            copy = text.split()
            for at in range(20, len(copy), 60):
                copy[at] = "changed"
            for held in (text.split(), copy):
                want.append((len(docs), i))
                docs.append((len(docs), " ".join([*words(rng, before), *held, *words(rng, 200)])))
    docs.append((len(docs), " ".join(items[0][1].split()[:400])))  # less than half of an item
    # two halves of a short item, further apart than the item is long: no hit beside a long item either
    docs.append((len(docs), " ".join([*items[4][1].split()[:34], *words(rng, 700), *items[4][1].split()[34:]])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    parts = decontaminate.item_parts(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    for shard_terms in (300, 1_000_000):
        got = decontaminate.leaks(table, parts, shard_terms=shard_terms).collect()
        hits = sorted((r["doc_id"], r["item_id"]) for r in got)
        assert hits == want


def test_wand_finds_what_scoring_all_finds():
    rng = random.Random(2)
    vocab = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(9000)]
    items = [(i, " ".join(vocab[30 * i : 30 * i + 20]), " ".join(vocab[30 * i + 20 : 30 * i + 30])) for i in range(300)]
    df = Counter(w for _, q, a in items for w in set(f"{q} {a}".split()))
    index = decontaminate.Index(items, {w: math.log(1 + (300 - c + 0.5) / (c + 0.5)) for w, c in df.items()}, 30)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), 25))
        scores = defaultdict(float)
        for t in terms:
            for d, v in zip(index.docs[t], index.impacts[t]):
                scores[d] += v
        for threshold in (0.05, 0.2, 0.5):
            assert {d for d, _ in index.search(terms, threshold)} == {d for d, s in scores.items() if s >= threshold - 1e-9}


def brute_targets(sizes, limit=3):
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def mix_table(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", "é", None, "z"] + ["hot"] * 6), " ".join(words(rng, rng.choice([0, 1, 5, 40, 300]))), 0) for i in range(n)]
    rows += [(n, "tiny", "one two three", 0), (n + 1, "a", None, 0), (n + 2, "a", "same text", 0), (n + 2, "a", "same text", 0), (None, "b", "no number", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, size int")


def test_mix(spark):
    rows, docs = mix_table(spark)
    got = mixing.mixed_sizes(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted(
        (k if k is not None else -1, len((t or "").split())) for k, _, t, _ in rows)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    aims = brute_targets(sizes)
    source = {k: s for k, s, _, _ in rows}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(aims[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= 4 * mixing.BLOCK + 0.03 * aim, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs.repartition(7)).collect()))
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    _, docs = mix_table(spark, seed=4)
    want = Counter()
    for r in mixing.mixed_sizes(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == +want


def test_slots_and_texts_are_shuffled_once(spark):
    """Slots grow with the input: they are not broadcast whatever Spark expects of their size; texts cross one shuffle."""
    _, docs = mix_table(spark, seed=6, n=40)
    for mixed in (mixing.mixed_sizes(docs), mixing.mixed_documents(docs)):
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "BroadcastHashJoin [place" in x and ("block" in x or "stretch" in x)]
    assert plan.split("Scan")[0].count("Exchange") == 1  # from the texts' scan to the result


def test_pieces_by_stretches(spark, monkeypatch):
    """Documents over many stretches of blocks: parts cover each whole, and each is taken as often as slots hold its block."""
    rows, docs = mix_table(spark, seed=7, n=60)
    docs = docs.union(spark.createDataFrame([(900, "hot", " ".join(["far"] * 2000), 0)], docs.schema))
    whole = sorted(map(str, mixing.mixed_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "STRETCH", 3)
    assert whole == sorted(map(str, mixing.mixed_sizes(docs).collect()))
    aims = mixing.targets(mixing.streams(docs))
    taken = Counter((r["place"], r["block"]) for r in mixing.slots(docs, mixing.shares(aims, mixing.BLOCK)).collect())
    held = defaultdict(list)
    for r in mixing.pieces(docs).collect():
        assert r["times"] == (taken[r["place"], r["block"]] if r["size"] else 0)
        held[r["doc_id"], r["print"], r["copy"], r["size"]].append((r["low"], r["high"]))
    assert len(held) == len(rows) + 1
    for (*_, size), parts in held.items():
        parts.sort()
        assert [0, *(high for _, high in parts)] == [*(low for low, _ in parts), size]


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 99):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


def test_spans_and_extensions():
    a, b = fingerprints.PrefixHashes("xabcabcabé"), fingerprints.PrefixHashes("zzabcabcabà")
    assert fingerprints.equal_spans(a, 1, a, 4, 5) and not fingerprints.equal_spans(a, 1, a, 2, 3)
    assert fingerprints.common_extension(a, 1, b, 2) == 8
    assert fingerprints.common_extension(a, 0, b, 0) == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = [None, "", "ab", "a" * 700, *(" ".join(words(rng, n)) for n in (3, 40, 400, 400)), "日本語" * 50]
    texts += [texts[6], texts[6]]
    rows = [(5 * i % 53, t) for i, t in enumerate(texts)] + [(None, "first"), (2, "tie b"), (2, "tie a")]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_chars int")
    order = sorted(((k is not None, k or 0, t or "") for k, t in rows))
    want = []
    for (full, k, t), (_, _, after) in zip(order, [*order[1:], order[0]]):
        e = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        want.append((k if full else None, len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = fingerprints.fingerprinted(docs).collect()
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, want))
    prints = defaultdict(set)
    for r in got:
        prints[r["n_chars"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["common_prefix"] >= r["n_chars"] - r["n_chars"] // 4
    big = [r for r in got if r["n_chars"] > 1000]
    assert all(0.35 < r["near_edited"] < 0.9 for r in big if r["near_edited"] < 1)
    assert len(prints[len(texts[6])]) == 1
    one = fingerprints.fingerprinted(docs.where("doc_id = 2 and text = 'tie a'")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprinted(docs.limit(0)).count() == 0


def brute_chat(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns).encode()).hexdigest()
    return len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget, history", [(chat.BUDGET, chat.HISTORY), (60, 40), (1, 1)])
def test_chat(spark, budget, history):
    rng = random.Random(3)
    talks = {
        1: [(0, "system", "be <kind>"), *((i, ("user", "assistant")[i % 2], " ".join(words(rng, 9))) for i in range(1, 30))],
        2: [(0, "user", CONTROL), (1, "assistant", CONTROL), (2, "assistant", "\\"), (3, "assistant", "<turn n=0 role=user>\\b</turn>\n")],
        3: [(None, None, None), (0, "assistant", ""), (0, "assistant", ""), (1, "odd role>\n", "x")],
        None: [(0, "assistant", "huge " * 3000)],
    }
    rows = [(c, n, r, t, 0) for c, ts in talks.items() for n, r, t in ts]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    shown = chat.windows(table, budget=budget, history=history)
    got = {r["conv_id"]: r for r in chat.formatted_conversations(table, budget=budget, history=history).collect()}
    assert {c: tuple(got[c][1:5]) for c in talks} == {c: brute_chat(ts) for c, ts in talks.items()}
    sizes = Counter()
    for r in shown.collect():
        sizes[r["conv_id"]] += len(r["formatted"])
        if budget == 60 and r["conv_id"] == 1 and r["window"]:
            assert r["formatted"].startswith("<turn n=0 role=system again>be \\lkind></turn>\n")
    assert sizes == Counter({c: got[c]["formatted_chars"] for c in talks})
    assert chat.formatted_conversations(table.limit(0)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, rng.randrange(5, 120), 800)
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["nastyone", "nastytwo", "vile"])
        rows.append((i, " ".join(w), 0.0))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, 0.0), (1001, "", 0.0), (0, rows[0][1], 0.0)], "doc_id long, text string, rejected double")
    seen = [x for x in labels if x[0] < 700] + [(None, 1, 1), (5, None, None), (3, 1, 0)]
    table = toxicity.label_categories(spark.createDataFrame(seen, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, table, toxicity.CATEGORIES, "toxic").collect()
    assert len(got) == 903
    held = [(r["rejected"], r["doc_id"] % 6 == 0) for r in got if 700 <= r["doc_id"] < 900]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(r["rejected"] for r in got if r["doc_id"] >= 1000)
    none = toxicity.scored(docs, table.limit(0), toxicity.CATEGORIES, "toxic")
    assert not any(r["rejected"] for r in none.collect())
    assert toxicity.scored(docs.limit(0), table, toxicity.CATEGORIES, "toxic").count() == 0


def test_registered_queries(spark):
    """The registered queries on the smallest tables, for those whose result plain Python can give."""
    q = llm_queries()
    assert len(q) == 10
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in q["op8_near_duplicates"](spark, SMALL).collect())
    assert got == brute_groups(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {(r["doc_id"], r["item_id"]) for r in q["op2_benchmark_leaks"](spark, SMALL).collect()}
    assert leaks >= {(k, i) for k, t in docs for i, x in items if x in (t or "")}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    turns[-7] = [(0, "user", CONTROL), (1, "assistant", CONTROL)]
    back = {r["conv_id"]: tuple(r[1:5]) for r in q["op7_chat_windows"](spark, SMALL).collect()}
    assert back == {c: brute_chat(ts) for c, ts in turns.items()}


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    twice = docs.union(docs)
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    want = sorted(r["doc_id"] for r in stage(spark, docs, SMALL).collect())
    assert sorted(r["doc_id"] for r in stage(spark, twice, SMALL).collect()) == want


def test_stages_decide_per_row(spark):
    """Rows that share a doc_id, or have none, are judged by their own texts."""
    rng = random.Random(21)
    one, two, three, four = (" ".join(words(rng, 60)) for _ in range(4))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, one), (2, one), (2, two), (None, three), (None, three), (None, four), (3, ""), (3, ""), (4, ""), (5, None), (5, None)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SMALL).collect()
    assert sorted(map(tuple, got), key=order) == sorted([(1, one), (2, two), (None, three), (None, four), (3, ""), (4, ""), (5, None)], key=order)
    rows = [(1, f"{one} {item}"), (1, two), (None, item), (None, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, SMALL).collect()
    assert sorted(map(tuple, got), key=order) == [(1, two), (None, three)]


def test_stages_keep_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns(
        {"rejected": F.lit("mine"), "_id": F.lit(5), "_text": F.lit("x"), "size": F.lit(None).cast("int"), "kept": F.lit(0)}
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        got = after.select("rejected", "_id", "_text", "size", "kept").distinct().collect()
        assert [tuple(r) for r in got] == [("mine", 5, "x", None, 0)], name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SMALL)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        if name == "near duplicates":
            pairs = [(r["doc_id"], r["text"]) for r in kept.collect()]
            want = {k for k, _, c in brute_groups(pairs) if k == c}
            assert {r["doc_id"] for r in after.collect()} == want
        kept = after
    last = corpus_pipeline.run(spark, SMALL).collect()
    ids = sorted(r["doc_id"] for r in last)
    assert ids == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    starts = [(r["doc_id"], r["start"], r["n_tokens"]) for r in sorted(last, key=lambda r: r["doc_id"])]
    at = 0
    for _, start, n in starts:
        assert start == at
        at += n
