"""Every gate of a pick: shown before, queued for this turn, alike to what was shown, twins."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.history import history_read
from palimpsest.operators.index import build_index
from palimpsest.operators.recall import fresh_hits
from palimpsest.operators.records import finish_records

WORDS = {i: " ".join(f"{w}{i}" for w in ("alpha", "bravo", "charlie", "delta", "echo", "foxtrot")) + "." for i in range(8)}


def test_all_gates(spark):
    picks = [
        (1, "s", 1, "f1", "T1", WORDS[1]), (2, "s", 1, "f2", "T2", WORDS[2]), (3, "s", 1, "f3", "T3", WORDS[3]),
        (4, "s", 1, "f4", "Same", WORDS[4]), (4, "s", 2, "f5", "Same", WORDS[5]),
        (5, "s", 1, "f6", "T6", WORDS[6]), (5, "s", 2, "f7", "T7", WORDS[6] + " golf"),
        (6, "s", 1, "f8", "T8", WORDS[7]), (7, "other", 1, "f1", "T1", WORDS[1]), (8, "s", 1, "f1", "T9", WORDS[0]), (8, "s", 2, "f9", "T9", WORDS[7] + " x"),
    ]
    picked = spark.createDataFrame(picks, "query_id int, session string, place int, fp string, title string, text string")
    shown = spark.createDataFrame(
        [("s", "f1", "nothing alike"), ("s", "f1", "nothing alike"), ("s", None, "T3 — " + WORDS[3]), ("s", "f99", "")], "session string, fp string, line string"
    )
    boost = spark.createDataFrame([("s", "T2 first. " + WORDS[2] + " and much more")], "session string, boost string")

    def reasons(**options):
        return {(r.query_id, r.place): r.drop_reason for r in fresh_hits(picked, **options).collect()}

    got = reasons(injected=shown, boost=boost)
    assert got == {
        (1, 1): "injected-fp", (2, 1): "boost-overlap", (3, 1): "injected-text", (4, 1): None, (4, 2): "same-title",
        (5, 1): None, (5, 2): "near-duplicate", (6, 1): None, (7, 1): None, (8, 1): "injected-fp", (8, 2): None,
    }
    plain = reasons(dedupe=False, injected=shown, boost=boost)
    assert {k for k, v in plain.items() if v} == {(4, 2), (8, 2)} and plain[4, 2] == "same-title"


def test_history_falls_back_to_the_log(spark):
    schema = ("session string, ord bigint, layer string, compaction_id string, at string, turn int, seq_start bigint, "
              "seq_end bigint, shadowed_tokens bigint, text string, src string, tool string")
    rows = [("s", i, "raw", "c", f"2026-01-0{i + 1}", None, None, i, None, WORDS[i], None, None) for i in range(4)]
    rows.append(("s", 9, "summary", "c", "2026-01-09", None, None, 9, None, "a summary is not old text", None, None))
    records = finish_records(spark.createDataFrame(rows, schema))
    turns = spark.createDataFrame(
        [("s", 1, 1, "alpha1 in the log?", ""), ("t", 1, 1, "alpha1 bravo1?", "yes, alpha1"), ("t", 2, 5, "other", "no")],
        "session string, turn_no bigint, seq bigint, user string, assistant string",
    )
    index = build_index(records.where("layer = 'raw'"))
    asked = spark.createDataFrame(
        [(1, "s", WORDS[1]), (2, "s", " "), (3, "t", "alpha1 bravo1"), (4, "t", None), (5, "t", "unknown"), (6, "u", "alpha1"), (7, "s", "log")],
        "query_id int, session string, text string",
    )

    def read(**options):
        rows = history_read(index, records, turns, asked, **options).collect()
        return sorted((r.query_id, r.place, r.source, r.text) for r in rows)

    got = read(limit=2)
    first = "问：alpha1 bravo1?\n答：yes, alpha1"
    assert got == [
        (1, 1, "store", WORDS[1]), (2, 1, "store", WORDS[2]), (2, 2, "store", WORDS[3]), (3, 1, "log", first),
        (4, 1, "log", first), (4, 2, "log", "问：other\n答：no"), (7, 1, "log", "问：alpha1 in the log?"),
    ]
    assert {r[2] for r in read(source="store")} == {"store"} and {r[2] for r in read(source="log")} == {"log"}
    cut = [r for r in read(limit=2, max_chars=len(WORDS[2]) + 5) if r[0] == 2]
    assert cut == [(2, 1, "store", WORDS[2]), (2, 2, "store", WORDS[3][:5])]
    with pytest.raises(ValueError):
        read(source="elsewhere")
    assert history_read(index, records.where(F.lit(False)), turns.where("false"), asked.where("false")).count() == 0


def test_shown_lines_are_made_once(spark):
    """The lines that earlier turns showed are costly: each is made once, however many steps read it."""
    picked = spark.createDataFrame([(1, "s", 1, "f1", "T1", WORDS[1])], "query_id int, session string, place int, fp string, title string, text string")
    made = spark.sparkContext.accumulator(0)

    def line(text):
        made.add(1)
        return text

    rows = spark.createDataFrame([("s", f"f{i}", WORDS[i]) for i in range(2, 7)], "session string, fp string, text string")
    shown = rows.select("session", "fp", F.udf(line, "string")("text").alias("line"))
    assert [r.drop_reason for r in fresh_hits(picked, injected=shown).collect()] == [None]
    assert made.value == 5
