import json

import zstandard
from pyspark.sql import functions as F

from palimpsest.operators.records import finish_records
from palimpsest.sources.session_log import (
    best_logs, find_log, frame_spans, log_files, parse_events, read_lines,
)
from palimpsest.sources.store import BlockStore, read_jsonl
from palimpsest.streaming.ingest import ingest_blocks
from palimpsest.streaming.state import rate_limited_stream, session_view

BLOCKS = (
    "session string, ord bigint, layer string, compaction_id string, at string, turn int, seq_start bigint, "
    "seq_end bigint, shadowed_tokens bigint, text string, src string, tool string"
)


def blocks(spark, *rows):
    full = [(s, o, "raw", "c", "2026-01-01T00:00:00.000Z", None, None, None, None, t, None, None) for s, o, t in rows]
    return spark.createDataFrame(full, BLOCKS)


def frames(*lines):
    return [zstandard.ZstdCompressor(write_checksum=True).compress((json.dumps(x) + "\n").encode()) for x in lines]


def test_frame_spans_and_torn_tail():
    parts = frames({"type": "a"}, {"type": "b"})
    data = b"".join(parts)
    assert frame_spans(data) == ([(0, len(parts[0])), (len(parts[0]), len(data))], None)
    spans, torn = frame_spans(data[:-3])
    assert len(spans) == 1 and torn == len(parts[0])


def test_session_log_roundtrip(spark, tmp_path):
    folder = tmp_path / "proj" / "session-abc1"
    folder.mkdir(parents=True)
    good = frames(
        {"type": "session", "id": "abc1", "cwd": "/w"},
        {"type": "user/message", "seq": 1, "time": 5, "data": {"source": {"kind": "user", "rpcId": "r"},
         "content": [{"type": "text", "text": "hello"}, {"type": "reasoning", "text": "no"}]}},
    )
    bad = bytearray(frames({"type": "broken"})[0])
    bad[-6] ^= 0xFF
    other = frames(["not an object"], {"type": 5})
    (folder / "session.v2.jsonl.zstd").write_bytes(b"".join([*good, bytes(bad), *other]))
    (folder / "session.jsonl").write_text('{"type":"old"}\nbroken\n')
    files = log_files(spark, str(tmp_path))
    assert files.count() == 2
    assert best_logs(files).first().path.endswith(".zstd")
    assert find_log(files, "session-ab").first().path.endswith("v2.jsonl.zstd")
    assert find_log(files, "nope").count() == 0
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("path").distinct().count() == 1  # one log of a session, whatever its size
    assert read_lines(spark, str(tmp_path), limit=10).count() == 0
    events = parse_events(lines).where(F.col("path").endswith(".zstd")).orderBy("line_no").collect()
    assert [e.type for e in events] == ["session", "user/message"]
    decoded = lines.where(F.col("path").endswith(".zstd")).first()
    assert (decoded.frames, decoded.failed, decoded.torn) == (5, 1, False)
    assert events[0].cwd == "/w"
    msg = next(e for e in events if e.type == "user/message")
    assert (msg.seq, msg.kind, msg.rpc_id, msg.blocks[0].text) == (1, "user", "r", "hello")


def test_store_lifecycle(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "store"))
    rows = finish_records(blocks(spark, ("s", 1, "alpha beta"), ("s", 2, "gamma delta"), ("t", 3, "alpha beta")))
    assert store.append(rows) == 3
    assert store.append(rows) == 0
    victim = store.records().where("ord = 3").select("session", "fp")
    assert store.delete(victim, "t1") == 1
    assert {r.ord for r in store.records().collect()} == {1, 2}
    assert store.trash().count() == 1
    assert store.restore("t1") == 1
    assert store.restore("t1") == 0
    assert {r.ord for r in store.records().collect()} == {1, 2, 3}
    changed = store.rewrite(
        lambda df: df.withColumn("keywords", F.array(F.lit("kw"))),
        spark.createDataFrame([("s",)], "session string"),
    )
    assert changed == 2
    assert {tuple(r.keywords) for r in store.records().where("session = 's'").collect()} == {("kw",)}
    assert store.records().count() == 3


def test_jsonl_drops_broken_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"session":"s","text":"ok"}\n{broken\n{"session":"s"}\n{"session":"s","text":""}\n')
    assert read_jsonl(spark, str(path)).count() == 2


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    store = BlockStore(spark, str(tmp_path / "store"))
    blocks(spark, ("s", 1, "alpha beta"), ("s", 2, "gamma")).write.mode("append").parquet(str(src))
    for turn in (1, 2):
        stream = spark.readStream.schema(BLOCKS).parquet(str(src))
        ingest_blocks(stream, store, str(tmp_path / f"cp{turn}")).awaitTermination()
        assert store.records().count() == 2


def test_session_view_and_limiter_stream(spark, tmp_path):
    schema = "session string, seq bigint, type string, text string, fp string"
    rows = [
        ("s", 1, "inbox", "why", ""), ("s", 2, "question", "why", ""), ("s", 3, "recall", "BLOCK", "f1"),
        ("s", 4, "recall", "OTHER", "f2"), ("s", 5, "boost", "EXTRA", ""), ("s", 6, "turn/end", "", ""),
        ("s", 7, "question", "and", ""), ("s", 8, "recall", "BLOCK", "f1"), ("s", 9, "turn/end", "", ""),
        ("s", 10, "compaction/end", "", ""), ("s", 11, "question", "x", ""), ("s", 12, "recall", "", ""),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "ev"))
    out = session_view(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")))
    q = out.writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: (r.action, r.text) for r in spark.table("shown").collect()}
    assert got[2] == ("ask@1", "why")
    assert got[3] == ("recall", "BLOCK") and got[4] == ("memo", "BLOCK")
    assert got[8] == ("repeat", "BLOCK\n\nEXTRA")
    assert got[12] == ("recall", "")
    calls = "key string, at_ms bigint"
    spark.createDataFrame([("k", t) for t in (1000, 1100, 1200, 2100)], calls).coalesce(1).write.parquet(str(tmp_path / "c"))
    lim = rate_limited_stream(spark.readStream.schema(calls).parquet(str(tmp_path / "c")), 1000, 2)
    q = lim.writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("lim").orderBy("at_ms").collect()] == [True, True, False, True]


def test_workspace_listing(spark, tmp_path):
    import gzip
    import os

    from palimpsest.sources.listing import newest_logs, session_files, workspace_records

    good = json.dumps({"session": "a", "ord": 1, "text": "kept"}) + "\n"
    (tmp_path / "a.jsonl").write_text(good + "broken {\n" + json.dumps({"session": "a", "ord": 2}) + "\n")
    (tmp_path / "b.jsonl").write_text(good.replace("kept", "too"))
    (tmp_path / "_audit.jsonl").write_text(good)
    packed = gzip.compress(good.encode() * 2000)
    (tmp_path / "c.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "empty.jsonl").write_text("")
    files = session_files(spark, str(tmp_path)).collect()
    assert sorted(f.session for f in files) == ["a", "b"]  # Spark passes over empty files
    assert {f.session: f.bytes for f in files}["b"] == len(good) - 1
    texts = {r.text for r in workspace_records(spark, str(tmp_path)).where("not file like '%c.jsonl.gz'").collect()}
    assert texts == {"kept", "too"}
    assert workspace_records(spark, str(tmp_path)).count() >= 2  # a torn file stops nothing
    folder = tmp_path / "logs" / "p" / "s1"
    folder.mkdir(parents=True)
    for name, at in (("session.v2.jsonl", 100), ("session.jsonl", 200), ("session.v3.jsonl", 50)):
        (folder / name).write_text("{}")
        os.utime(folder / name, (at, at))
    (newest,) = newest_logs(log_files(spark, str(tmp_path / "logs"))).collect()
    assert newest.path.endswith("/session.jsonl")


def test_known_workspaces_keep_the_first_place(spark):
    from palimpsest.sources.listing import known_workspaces

    lists = [[("b", 1), ("a", 2), ("", 3)], [("a", 1), ("c", 9), (None, 2)], [("d", 1), ("b", 0)], []]
    frames = [spark.createDataFrame(x, "workspace string, pos int") for x in lists]
    assert [r.workspace for r in known_workspaces(frames).orderBy("place").collect()] == ["b", "a", "c", "d"]
    assert known_workspaces([frames[3]]).count() == 0
