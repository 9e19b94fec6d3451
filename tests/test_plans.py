import pytest
from pyspark.sql import functions as F

from palimpsest.operators.index import build_index
from palimpsest.plans.ingest import compaction_records
from palimpsest.plans.recall import attempts, cooled_down, recall_blocks
from palimpsest.session import settle
from palimpsest.settings import Settings

EVENTS = (
    "session string, seq bigint, type string, kind string, text string, call_id string, name string, "
    "args string, is_error boolean"
)
COMPACTIONS = (
    "session string, compaction_id string, seq bigint, time_ms bigint, turn int, seq_start bigint, "
    "seq_end bigint, shadowed_tokens bigint, text string"
)


def test_settings_clamp_and_reject():
    loaded = Settings.load({"maxItems": 99, "minScore": -1, "dedupe": "no", "timeBellWidth": 9})
    assert (loaded.maxItems, loaded.minScore, loaded.dedupe, loaded.timeBellWidth) == (5, 0.28, True, 2)
    assert Settings().change(maxItems=1).maxItems == 1
    for bad in ({"maxItems": 6}, {"nope": 1}, {"dedupe": 1}, {"minScore": -0.1}, {"timeBellWidth": 1.0}):
        with pytest.raises(ValueError):
            Settings().change(**bad)


def test_events_to_recall_block(spark):
    u, a = "user/message", "assistant/message"
    rows = [
        ("s", 1, u, "user", "How do we roll back the database migration?", None, None, None, None),
        ("s", 2, a, None, "Restore the snapshot, replay the queue, then notify support staff.", None, None, None, None),
        ("s", 3, "tool/call", None, None, "c1", "read", '{"path":"docs/ops/rollback.md"}', None),
        ("s", 4, "tool/result", None, "rollback file body with snapshot retention policy", "c1", None, None, False),
        ("s", 5, "tool/result", None, "orphan", "c9", None, None, False),
        ("s", 6, u, "user", "Which printer needs toner?", None, None, None, None),
        ("s", 9, u, "user", "remind me: database migration roll back snapshot queue?", None, None, None, None),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    summary = "# Plan\n决定 to keep the nightly snapshot for thirty days and to page the owner on failure every time.\n"
    compactions = spark.createDataFrame(
        [("s", "c1", 8, 1767225600000, 2, 1, 7, 500, summary)], COMPACTIONS)
    records = settle(compaction_records(events, compactions))
    got = records.orderBy("ord").collect()
    assert [(r.layer, r.src) for r in got] == [("summary", None), ("raw", None), ("raw", "tool")]
    assert got[0].title == "Plan" and got[0].at == "2026-01-01T00:00:00.000Z"
    assert got[1].text.startswith("问：How do we") and "\n\n问：Which printer" in got[1].text
    assert got[2].title == "工具 read：ops/rollback.md" and (got[2].seq_start, got[2].seq_end) == (4, 4)
    assert got[2].text.startswith("【工具 read 的结果 · ops/rollback.md】\nrollback file body")
    asked = attempts(events)
    assert [r.step for r in asked.collect()] == [0]
    index = build_index(records).settled()
    (block,) = recall_blocks(index, records, asked).collect()
    assert "Restore the snapshot" in block.text and block.tokens <= 700
    shown = records.where("ord = %d" % got[1].ord).select("session", "fp", F.lit("x").alias("line"))
    again = recall_blocks(index, records, asked, injected=shown).collect()
    assert all(got[1].fp not in r.fps for r in again)
    assert cooled_down(asked, asked).count() == 0
