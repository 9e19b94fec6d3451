"""Raw events: the dispatcher, and the stream's records against those of the batch plan."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.records import first_occurrences
from palimpsest.plans.events import backfill, dispatch
from palimpsest.plans.ingest import compaction_records
from palimpsest.settings import Settings
from palimpsest.sources.session_log import parse_events
from palimpsest.streaming.raw_events import EventIngest, line_stream

HOUR = 3_600_000
START = 1767225600000
COMPARED = ["session", "layer", "compaction_id", "at", "turn", "seq_start", "seq_end", "shadowed_tokens", "title", "keywords", "text", "fp", "src", "tool"]


def block(text):
    return [{"type": "text", "text": text}, {"type": "image", "text": "not text"}]


def session_lines(rng, seqs, session):
    """Log lines by seq, with three compactions; the last one covers nothing and has a summary only."""
    topics = ["printer toner order", "database snapshot rollback", "holiday roster change", "invoice export fault"]
    lines, seq, time = {}, 0, START
    ends = [seqs // 3, 2 * seqs // 3, seqs]
    low = 1
    while seq < seqs:
        seq += 1
        time += HOUR
        topic = rng.choice(topics)
        if seq in ends:
            last = seq == ends[-1]
            data = {"compactionId": f"{session}-c{seq}", "turn": seq, "shadowedTokenCount": 9,
                    "summary": block(f"# Summary {seq}\nThe team decided to keep the {topic} under review every week, item {seq}.")}
            if not last:
                data["shadowedRange"] = {"start": low, "end": seq + 5}
                low = seq - 4
            lines[seq] = {"type": "compaction/summary", "seq": seq, "time": time, "data": data}
        elif seq % 7 == 3:
            lines[seq] = {"type": "tool/call", "seq": seq, "time": time, "data": {"callId": f"k{seq}", "name": "read", "arguments": json.dumps({"path": f"docs/a/{seq}.md"})}}
        elif seq % 7 == 4:
            lines[seq] = {"type": "tool/result", "seq": seq, "time": time, "data": {"message": {"toolCallId": f"k{seq - 1}", "isError": False, "content": block(f"file body {seq} on {topic}")}}}
        elif seq % 2:
            lines[seq] = {"type": "user/message", "seq": seq, "time": time, "data": {"source": {"kind": "user", "rpcId": "r"}, "content": block(f"How about the {topic}, number {seq}?")}}
        else:
            lines[seq] = {"type": "assistant/message", "seq": seq, "time": time, "data": {"message": {"id": f"m{seq}", "content": block(f"We handle the {topic} in step {seq} of the plan.")}}}
    return lines


def put(root, session, version, lines):
    folder = Path(root) / "project" / session
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"session.v{version}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "broken {\n")


def batch_lines(spark, root):
    return spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.col("_metadata.file_path").alias("path"), F.lit(0).alias("line_no"), F.col("value").alias("line")
    )


def rows_of(records):
    return [tuple(r[c] for c in COMPARED) for r in records.orderBy("session", "ord").collect()]


def batch_plan(spark, root):
    raw = parse_events(batch_lines(spark, root)).dropDuplicates(["session", "seq"])
    routed = dispatch(raw)
    return rows_of(first_occurrences(compaction_records(routed.events, routed.compactions)))


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(11)
    return {f"s{i}": session_lines(rng, n, f"s{i}") for i, n in enumerate((42, 60))}


def test_dispatch(spark, tmp_path, sessions):
    extra = [
        {"type": "compaction/end", "seq": 90, "time": START}, {"type": "compaction/prune", "seq": 91, "time": START, "data": {"shadowedRange": {"start": 1, "end": 4}}},
        {"type": "turn/start", "seq": 92, "time": START, "data": {"turn": 4}}, {"type": "turn/end", "seq": 93, "time": START, "data": {"turn": 4}},
        {"type": "compaction/summary", "seq": 94, "time": START, "data": {"compactionId": " ", "summary": block("x")}}, {"type": "other", "seq": 95}, {"type": "other"},
    ]
    put(tmp_path, "s0", 1, [*sessions["s0"].values(), *extra])
    raw = parse_events(batch_lines(spark, str(tmp_path)))
    routed = dispatch(raw, Settings(includePrune=True))
    assert routed.compactions.count() == 3 and routed.recaps.first().seq == 90
    assert routed.compactions.where("seq_end > seq").count() == 0
    assert routed.prunes.select("seq_start", "seq_end").collect() == [(1, 4)]
    assert sorted(routed.turns.select("turn", "starts").collect()) == [(4, False), (4, True)]
    assert {r.text[:9] for r in routed.questions.collect()} == {"How about"}
    assert routed.events.count() == raw.count() - 1
    assert dispatch(raw).prunes.count() == 0
    assert dispatch(raw, Settings(ingestSummary=False, ingestRawText=False)).compactions.count() == 0


def test_stream_gives_the_records_of_the_batch_plan(spark, tmp_path, sessions):
    root, ckpt = str(tmp_path / "logs"), str(tmp_path / "ckpt")
    ingest = EventIngest(spark, str(tmp_path / "store"), delay="10 days")

    def run(target=ingest, checkpoint=ckpt):
        query = target.start(line_stream(spark, root, files_per_batch=4), checkpoint)
        query.awaitTermination()
        assert query.exception() is None

    for name, lines in sessions.items():  # the first part, but for two events that come late
        put(root, name, 1, [line for seq, line in lines.items() if seq <= len(lines) // 2 and seq % 11 != 5])
    run()
    first = rows_of(ingest.records())
    assert first == batch_plan(spark, root) and first
    before = ingest.versions().count()
    run()  # nothing new: no new version
    assert ingest.versions().count() == before
    for name, lines in sessions.items():
        put(root, name, 2, [line for seq, line in lines.items() if seq > len(lines) // 2])
        put(root, name, 3, [line for seq, line in lines.items() if seq <= len(lines) // 2 and seq % 11 == 5])
        put(root, name, 4, list(lines.values())[:5])  # delivered twice
    run()
    wanted = batch_plan(spark, root)
    assert rows_of(ingest.records()) == wanted and len(wanted) > len(first)
    assert any("number 5?" in r[10] for r in wanted)
    # a batch whose end was never noted is run again and changes nothing
    commits = sorted((Path(ckpt) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    done = ingest.versions().count()
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert ingest.versions().count() == done and rows_of(ingest.records()) == wanted
    # another ingest of everything at once
    whole = EventIngest(spark, str(tmp_path / "whole"), delay="10 days")
    run(whole, str(tmp_path / "ckpt2"))
    assert rows_of(whole.records()) == wanted


def test_older_events_come_from_the_archive(spark, tmp_path, sessions):
    root = str(tmp_path / "logs")
    put(root, "s1", 1, list(sessions["s1"].values()))
    archive = parse_events(batch_lines(spark, root))
    ingest = EventIngest(spark, str(tmp_path / "store"), archive=archive, delay="1 minute", horizon="3 hours")
    ingest.start(line_stream(spark, root), str(tmp_path / "ckpt")).awaitTermination()
    assert rows_of(ingest.records()) == batch_plan(spark, root)
    without = EventIngest(spark, str(tmp_path / "short"), delay="1 minute", horizon="3 hours")
    without.start(line_stream(spark, root), str(tmp_path / "ckpt2")).awaitTermination()
    assert rows_of(without.records()) != batch_plan(spark, root)


def test_backfill_takes_unseen_compactions_once(spark, tmp_path, sessions):
    put(tmp_path, "s1", 1, [*sessions["s1"].values(), sessions["s1"][20]])
    raw = parse_events(batch_lines(spark, str(tmp_path)))
    known = spark.createDataFrame([("s1", "s1-c40"), ("s9", "s1-c20")], "session string, compaction_id string")
    got = backfill(raw, known)
    assert {r.compaction_id for r in got.collect()} == {"s1-c20", "s1-c60"}
    assert backfill(raw, got.select("session", "compaction_id").union(known)).count() == 0
