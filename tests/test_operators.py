import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import mutations as M
from palimpsest.operators import packing, timepos
from palimpsest.operators.diagnose import verdicts
from palimpsest.operators.index import build_index
from palimpsest.operators.ordered import exact_rank, last_before, row_number
from palimpsest.operators.records import finish_records, first_occurrences
from palimpsest.operators.search import search
from palimpsest.operators.tiers import segmented, two_tier
from palimpsest.operators.turns import conversation_turns, in_ranges
from palimpsest.streaming.state import rate_limited


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 4)}", i, rng.randint(0, 9)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "k string, n bigint, v int")


def test_row_number_over_many_slices(spark, events):
    rows, df = events
    want, seen = {}, {}
    for k, n, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        want[(k, n)] = seen[k]
    got = {(r.k, r.n): r.x for r in row_number(df, ["k"], "n", "x", width=7).collect()}
    assert got == want


def test_last_before_over_many_slices(spark, events):
    rows, df = events
    want, last = {}, {}
    for k, n, v in rows:
        want[(k, n)] = last.get(k)
        if v == 0:
            last[k] = n
    value = F.when(F.col("v") == 0, F.col("n"))
    got = {(r.k, r.n): r.x for r in last_before(df, ["k"], "n", value, "x", width=5).collect()}
    assert got == want


def test_exact_rank_matches_sort(spark, events):
    rows, df = events
    got = {(r.k, r.n): r.x for r in exact_rank(df, ["k"], [F.col("v"), F.col("n")], "x").collect()}
    by_key = {}
    for k, n, v in rows:
        by_key.setdefault(k, []).append((v, n))
    want = {(k, n): i for k, vs in by_key.items() for i, (v, n) in enumerate(sorted(vs))}
    assert got == want


@pytest.mark.parametrize("sizes", ["mixed", "equal"])
def test_packing_across_slices(spark, monkeypatch, sizes):
    monkeypatch.setattr(packing, "SLICE", 16)
    monkeypatch.setattr(packing, "GROUP", 4)
    rng = random.Random(11)
    data = [(k, n, rng.randint(30, 70) if sizes == "mixed" else 40)
            for k, count in (("hot", 500), ("b", 17), ("c", 1), ("d", 64)) for n in range(count)]
    want, state = {}, {}
    for k, n, size in data:
        total, chunk = state.get(k, (None, None))
        fits = total is not None and total + size + 2 <= 200
        state[k] = (total + size + 2, chunk) if fits else (size, n)
        want[(k, n)] = state[k][1]
    df = spark.createDataFrame(data, "k string, n bigint, size int")
    got = {(r.k, r.n): r.chunk for r in packing.greedy_chunks(df, "k", target=200).collect()}
    assert got == want


@pytest.mark.parametrize("size", [0, 1, 2, 5])
def test_packing_of_small_pieces(spark, size):
    rows = [("k", i, size) for i in range(9000)]
    want, first, total = {}, 0, 0
    for i in range(9000):
        if i > first and total + 2 + size > 900:
            first, total = i, size
        else:
            total = size if i == first else total + 2 + size
        want[i] = first
    df = spark.createDataFrame(rows, "k string, n bigint, size int")
    assert {r.n: r.chunk for r in packing.greedy_chunks(df, "k").collect()} == want


def test_verdict_reads_every_absent_word(spark):
    words = [f"unknown{chr(97 + i)}word" for i in range(26)]
    records = finish_records(spark.createDataFrame(
        [(1, "s", "summary", "c", "2024", 1, 2, None, "something else entirely in here", None, None)],
        "ord bigint, session string, layer string, compaction_id string, at string, seq_start bigint, seq_end bigint, "
        "shadowed_tokens bigint, text string, src string, tool string",
    ))
    ask = spark.createDataFrame([(1, "s", " ".join(words))], "query_id bigint, session string, text string")
    for lost in (words[3], words[24]):
        dropped = spark.createDataFrame([("s", f"was {lost} once")], "session string, text string")
        row = verdicts(build_index(records), ask, dropped=dropped).first()
        assert (row.verdict, len(row.absent)) == ("not-ingested", row.total)


def test_running_budget_skips_and_continues(spark):
    rng = random.Random(5)
    data = [("a" if i % 3 else "b", i, rng.choice([3, 7, 20, 41])) for i in range(300)]
    used, want = {}, set()
    for k, i, c in data:
        if used.get(k, 0) + c <= 150:
            used[k] = used.get(k, 0) + c
            want.add((k, i))
    df = spark.createDataFrame(data, "k string, i bigint, cost int")
    got = {(r.k, r.i) for r in packing.running_budget(df, "k", "i", "cost", 150).collect()}
    assert got == want


def test_turns_skip_retries(spark):
    u, a = "user/message", "assistant/message"
    rows = [
        (1, a, "user", "early"), (2, u, "user", "q1"), (3, u, "user", "q1"), (4, u, "system", "note"),
        (5, u, "user", "q1"), (6, a, "user", "one"), (7, a, "user", "two"), (8, u, "user", "q1"), (9, u, "user", " "),
    ]
    df = spark.createDataFrame([("s", *r) for r in rows], "session string, seq bigint, type string, kind string, text string")
    got = [(r.turn_no, r.seq, r.user, r.assistant) for r in conversation_turns(df).orderBy("turn_no").collect()]
    assert got == [(1, 2, "q1", "one\ntwo"), (2, 8, "q1", "")]


def test_ranges_overlap_and_cross_slices(spark):
    rng = random.Random(9)
    events = [(rng.choice("aab"), rng.randint(-5, 400)) for _ in range(500)]
    ranges = [("a", 0, 399, 1), ("a", 50, 60, 2), ("a", 55, 300, 3), ("b", -100, 10**12, 4), ("b", 7, 6, 5), ("c", 0, 9, 6), ("a", None, 3, 7)]
    want = sorted((s, q, n) for s, q in events for t, lo, hi, n in ranges if s == t and lo is not None and lo <= q <= hi)
    e = spark.createDataFrame(events, "session string, seq bigint")
    r = spark.createDataFrame(ranges, "session string, seq_start bigint, seq_end bigint, n int")
    assert sorted((x.session, x.seq, x.n) for x in in_ranges(e, r, width=16).collect()) == want


def test_rate_limiter(spark):
    times = [1000, 1100, 1200, 2100]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "key string, n bigint, at_ms bigint")
    got = [r.allowed for r in rate_limited(df, 1000, 2).orderBy("n").collect()]
    assert got == [True, True, False, True]


def make_index(spark, texts, at=None):
    rows = [("s", i, "raw" if i % 2 else "summary", "c", (at or {}).get(i, "2026-01-01T00:00:00.000Z"), i, t)
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "session string, ord bigint, layer string, compaction_id string, at string, seq_end bigint, text string")
    return build_index(finish_records(df.withColumn("src", F.lit(None).cast("string")).withColumn("tool", F.lit(None).cast("string")))).settled()


TEXTS = [
    "The deployment window moved to Friday night because of the database migration.",
    "Lunch was noodles again and somebody spilled tea over the keyboard.",
    "Database migration rollback plan: restore snapshot, replay the queue, notify support.",
    "Printer on the second floor needs toner and a new paper tray.",
    "Weekend hiking trip photos are in the shared folder now.",
]


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_gate_blocks_unrelated_even_at_tiny_threshold(spark):
    index = make_index(spark, TEXTS)
    hits = two_tier(index, ask(spark, "quantum entanglement of the keyboard maybe"), min_score=0.01)
    assert hits.where("picked").count() == 0


def test_unknown_tail_does_not_lower_the_score(spark):
    index = make_index(spark, TEXTS)
    base = "database migration rollback snapshot queue"
    rows = search(index, ask(spark, base, base + " zzqx vvwk xxyy"), limit=1).collect()
    scores = {r.query_id: r.score for r in rows}
    assert scores[0] == scores[1] > 0.28


def test_denominator_cap_never_changes_order(spark):
    index = make_index(spark, TEXTS * 1 + [t + " extra words here" for t in TEXTS])
    q = ask(spark, " ".join(TEXTS))
    for cap in (0, 3, 12):
        order = [r.ord for r in search(index, q, limit=8, min_matched=1, top_idf=cap).orderBy("rank").collect()]
        if cap == 0:
            first = order
        assert order == first


def test_single_segment_equals_two_tier(spark):
    index = make_index(spark, TEXTS)
    q = ask(spark, "database migration rollback snapshot queue")
    a = {(r.ord, r.place) for r in two_tier(index, q).where("picked").collect()}
    b = {(r.ord, r.place) for r in segmented(index, q).where("picked").collect()}
    assert a == b and a


def test_two_topics_both_found(spark):
    index = make_index(spark, [TEXTS[0], "-", TEXTS[3], "-", TEXTS[1]])
    q = ask(spark, "deployment window Friday database migration? printer second floor toner paper tray?")
    got = {r.ord for r in segmented(index, q).where("picked").collect()}
    assert got == {0, 2}


def test_time_rerank_keeps_the_set_and_reverses(spark):
    same = "Database migration plan restore snapshot replay queue, variant number "
    at = {i: f"2026-01-0{i + 1}T00:00:00.000Z" for i in range(0, 6, 2)}
    texts = [same + str(i) if i % 2 == 0 else "-" for i in range(6)]
    index = make_index(spark, texts, at)
    q = ask(spark, "just now database migration plan snapshot", "earliest database migration plan snapshot")
    rows = segmented(index, q).where("layer = 'summary'").collect()
    order = {i: [r.ord for r in sorted(rows, key=lambda r: r.place) if r.query_id == i] for i in (0, 1)}
    assert set(order[0]) == set(order[1]) == {0, 2, 4}
    assert order[0][0] == 4 and order[1][0] == 0


def test_both_ends_coefficients(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.25, 0.5, 0.75, 1.0)], "p double")
    got = [r.c for r in df.select("p", timepos.coefficient(F.lit("both_ends"), F.col("p")).alias("c")).orderBy("p").collect()]
    assert got == pytest.approx([1.35, 1.2525, 1.22, 1.2525, 1.35])


def test_restore_counts_second_time_restores_nothing(spark):
    cols = "session string, layer string, compaction_id string, fp string, ord bigint, trash_id string"
    trash = spark.createDataFrame([("s", "raw", "c", f"f{i % 2}", i, "t") for i in range(4)], cols)
    empty = trash.limit(0)
    assert [tuple(r) for r in M.restore_counts(trash, empty).collect()] == [("t", 2, 2)]
    back = M.restorable(trash, empty)
    assert [tuple(r) for r in M.restore_counts(trash, back).collect()] == [("t", 0, 4)]


def test_text_work_widens_with_the_bytes(spark, monkeypatch):
    """Tasks share the texts by bytes, not by a fixed number of partitions."""
    import palimpsest.session as session
    from palimpsest.operators.index import build_index
    from palimpsest.operators.records import finish_records

    schema = ("session string, ord bigint, layer string, compaction_id string, at string, turn int, seq_start bigint, "
              "seq_end bigint, shadowed_tokens bigint, text string, src string, tool string")
    rows = [("s", i, "raw", "c", None, None, None, i, None, f"word{i} other{i} " * 5, None, None) for i in range(40)]
    blocks = spark.createDataFrame(rows, schema)
    assert session.text_parts(blocks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.text_parts(blocks.where("false")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = sorted(map(tuple, build_index(finish_records(blocks)).postings.collect()))
    monkeypatch.setattr(session, "TASK_BYTES", 500)
    parts = session.text_parts(blocks)
    assert parts == -(-sum(len(r[9]) for r in rows) // 500) > 4
    postings = build_index(session.settle(finish_records(blocks, parts=parts))).postings
    assert postings.rdd.getNumPartitions() == parts
    assert sorted(map(tuple, postings.collect())) == whole


def test_questions_leave_the_postings_where_they_lie(spark):
    """Few questions are sent to the postings; the vocabulary is neither counted nor shuffled for them."""
    from palimpsest.operators.diagnose import coverage

    schema = ("session string, ord bigint, layer string, compaction_id string, at string, turn int, seq_start bigint, "
              "seq_end bigint, shadowed_tokens bigint, text string, src string, tool string")
    rows = [("s", i, "raw", "c", None, None, None, i, None, f"word{i} alpha beta{i % 7}", None, None) for i in range(60)]
    index = build_index(finish_records(spark.createDataFrame(rows, schema))).settled()
    asked = spark.createDataFrame([(1, "s", "alpha word3 nothing"), (2, "t", "alpha")], "query_id bigint, session string, text string")
    known = index.terms_of(spark.createDataFrame([("s", "alpha"), ("s", "nothing"), ("t", "alpha")], "session string, token string"))
    assert [tuple(r) for r in known.collect()] == [("s", "alpha", 60)]
    covered = coverage(index, asked)
    assert sorted((r.query_id, r.total, r.present, r.absent) for r in covered.collect()) == [(1, 3, 2, ["nothing"]), (2, 1, 0, ["alpha"])]
    plan = search(index, asked)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("postings")
    assert "BroadcastHashJoin" in plan and "Exchange" not in plan[plan.rindex("BroadcastHashJoin", 0, scan):scan].replace("BroadcastExchange", "")


def test_keywords_and_postings_of_repeated_ords(spark):
    """Rows that share an ``ord`` count together, wherever a batch ends."""
    from palimpsest.operators.index import postings_of
    from palimpsest.operators.records import keywords_by_id

    texts = [(1, "red red blue"), (1, "blue green"), (None, "lost words"), (2, ""), (3, None), (4, "one two"), (4, "two"), (4, "two")]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("title", F.lit("green"))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        got = {r["id"]: r["keywords"] for r in keywords_by_id(df, "id", "text", "title", F.lit(2)).collect()}
        blocks = df.select(
            F.lit("s").alias("session"), F.col("id").alias("ord"), F.lit("raw").alias("layer"), F.lit("").alias("title"),
            F.array().cast("array<string>").alias("keywords"), "text",
        ).repartition(3, "ord")
        counted = sorted((r["ord"] or 0, r.token, r.tf, r.len) for r in postings_of(blocks).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {None: ["lost", "words"], 1: ["green", "blue"], 4: ["two", "one"]}
    assert counted == [
        (0, "lost", 1.0, 2.0), (0, "words", 1.0, 2.0), (1, "blue", 1.0, 2.0), (1, "blue", 1.0, 3.0), (1, "green", 1.0, 2.0),
        (1, "red", 2.0, 3.0), (4, "one", 1.0, 2.0), (4, "two", 1.0, 2.0), (4, "two", 2.0, 1.0),
    ]


def test_texts_of_first_occurrences_are_spread_once(spark):
    rows = [("s", i, "raw", f"t{i}", f"f{i % 5}", f"text {i}") for i in range(20)] + [("s", 3, "raw", "t3", "f3", "text 3")]
    rows.append(("s", None, "raw", "t", "f9", "no order"))
    records = spark.createDataFrame(rows, "session string, ord long, layer string, title string, fp string, text string")
    kept = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k) for k in kept}
    try:
        spark.conf.set(kept[0], "false")
        spark.conf.set(kept[1], "-1")
        wide = first_occurrences(records, 9)
        plan = wide._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("RepartitionByExpression")  # texts are not joined before they are spread
        assert wide.rdd.getNumPartitions() == 9
        assert wide.columns == records.columns
        assert sorted(r["ord"] for r in wide.collect()) == [0, 1, 2, 3, 3, 4]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
