"""Session events: turns, questions, tool results, packing, ranges and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.operators import packing, tools, turns
from palimpsest.operators.ordered import last_before, row_number
from palimpsest.sources.tables import conversation_events, table

registry = Registry()

EVENTS = """ev AS (SELECT conv_id AS session, turn + 1 AS seq,
  CASE WHEN role = 'assistant' THEN 'assistant/message' ELSE 'user/message' END AS type,
  CASE WHEN role = 'system' THEN 'system' ELSE 'user' END AS kind, text FROM conversations)"""

TURNS = f"""{EVENTS},
spoken AS (SELECT session, seq, type, text FROM ev
  WHERE (type = 'assistant/message' OR kind = 'user') AND {S.trim('text')} <> ''),
lagged AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px FROM spoken
  WINDOW w AS (PARTITION BY session ORDER BY seq)),
opened AS (SELECT *, sum(CASE WHEN type = 'user/message' THEN 1 ELSE 0 END)
    OVER (PARTITION BY session ORDER BY seq) AS turn_no
  FROM lagged WHERE NOT coalesce(type = 'user/message' AND pt = 'user/message' AND px = text, FALSE)),
turns AS MATERIALIZED (SELECT session, CAST(turn_no AS BIGINT) AS turn_no, min(seq) AS seq,
    max(CASE WHEN type = 'user/message' THEN text END) AS user,
    coalesce(string_agg(CASE WHEN type = 'assistant/message' THEN text END, chr(10) ORDER BY seq), '') AS assistant
  FROM opened WHERE turn_no > 0 GROUP BY session, turn_no)"""


@registry.add("conversation_turns", f"WITH {TURNS} SELECT * FROM turns")
def conversation_turns(spark, sf_dir):
    return turns.conversation_turns(conversation_events(spark, sf_dir))


@registry.add(
    "last_n_questions",
    f"""WITH {EVENTS}, asked AS (SELECT session, seq, {S.trim('text')} AS text FROM ev
  WHERE type = 'user/message' AND kind = 'user' AND {S.trim('text')} <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS r FROM asked)
SELECT session, string_agg(text, chr(10) ORDER BY seq) AS text, arg_max(text, seq) AS latest, max(seq) AS seq
FROM ranked WHERE r <= 3 GROUP BY session""",
)
def last_n_questions(spark, sf_dir):
    return turns.last_questions(conversation_events(spark, sf_dir), 3)


@registry.add(
    "message_question_asof",
    f"""WITH {EVENTS}, m AS (
  SELECT e.session, e.seq,
    coalesce((SELECT max(a.seq) FROM ev a WHERE a.session = e.session AND a.type = 'assistant/message' AND a.seq < e.seq), 0) AS previous_seq
  FROM ev e WHERE e.type = 'assistant/message'),
q AS (
  SELECT m.session, m.seq, m.previous_seq, max(u.seq) AS qs FROM m LEFT JOIN ev u
    ON u.session = m.session AND u.type = 'user/message' AND u.kind = 'user' AND u.seq > m.previous_seq AND u.seq < m.seq
  GROUP BY ALL)
SELECT q.session, q.seq, q.previous_seq, coalesce(q.qs, -1) AS question_seq,
  CASE WHEN q.qs IS NULL THEN '' ELSE {S.trim('u.text')} END AS question,
  CASE WHEN q.qs IS NULL THEN 'no-question' ELSE '' END AS reason
FROM q LEFT JOIN ev u ON u.session = q.session AND u.seq = q.qs""",
)
def message_question_asof(spark, sf_dir):
    return turns.message_questions(conversation_events(spark, sf_dir))


@registry.add(
    "previous_event_asof",
    """SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS has_previous,
  coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous_purchase
FROM events""",
)
def previous_event_asof(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    seen = last_before(table(spark, sf_dir, "events"), ["user_id"], "event_id", bought, "_p", 1000)
    return seen.select(
        "event_id", "user_id", F.col("_p").isNotNull().alias("has_previous"),
        F.coalesce("_p", F.lit(-1)).alias("previous_purchase"),
    )


@registry.add(
    "event_row_number",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events",
)
def event_row_number(spark, sf_dir):
    return row_number(
        table(spark, sf_dir, "events"), ["user_id"], "event_id", "n", 1000
    ).select("event_id", "user_id", "n")


@registry.add(
    "seq_range_ingest",
    f"""WITH {EVENTS}, r AS (SELECT session, 1 AS lo, max(seq) - 1 AS hi FROM ev GROUP BY session)
SELECT e.session, e.seq, e.type FROM ev e JOIN r ON r.session = e.session AND e.seq BETWEEN r.lo AND r.hi
WHERE r.hi >= r.lo""",
)
def seq_range_ingest(spark, sf_dir):
    events = conversation_events(spark, sf_dir)
    ranges = events.groupBy("session").agg(
        F.lit(1).alias("seq_start"), (F.max("seq") - 1).alias("seq_end")
    )
    return turns.in_ranges(events, ranges).select("session", "seq", "type")


_WALK = """walk AS (
  SELECT {key}, n, size AS total, n AS chunk FROM pieces WHERE n = 0
  UNION ALL
  SELECT p.{key}, p.n, CASE WHEN w.total + p.size + 2 <= 900 THEN w.total + p.size + 2 ELSE p.size END,
    CASE WHEN w.total + p.size + 2 <= 900 THEN w.chunk ELSE p.n END
  FROM walk w JOIN pieces p ON p.{key} = w.{key} AND p.n = w.n + 1)"""


@registry.add(
    "greedy_packing",
    f"""WITH RECURSIVE pieces AS MATERIALIZED (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n,
    length(event_type || ' ' || props) * (1 + event_id % 7) AS size FROM events),
{_WALK.format(key='user_id')} SELECT user_id, n, chunk FROM walk""",
)
def greedy_packing(spark, sf_dir):
    """Event texts of each user packed to 900 characters."""
    size = F.length(F.concat_ws(" ", "event_type", "props")) * (1 + F.col("event_id") % 7)
    numbered = row_number(table(spark, sf_dir, "events"), ["user_id"], "event_id", "_n")
    pieces = numbered.select("user_id", (F.col("_n") - 1).alias("n"), size.cast("int").alias("size"))
    return packing.greedy_chunks(pieces, "user_id")


_RAW = f"""WITH RECURSIVE {TURNS},
pieces AS MATERIALIZED (
  SELECT session, seq, user, piece, length(piece) AS size,
    row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS n
  FROM (SELECT *, '问：' || user || CASE WHEN assistant = '' THEN '' ELSE chr(10) || '答：' || assistant END AS piece FROM turns)),
{_WALK.format(key='session')},
chunks AS (
  SELECT w.session, w.chunk, min(p.seq) AS seq, arg_min(p.user, p.n) AS question,
    string_agg(p.piece, chr(10) || chr(10) ORDER BY p.n) AS text
  FROM walk w JOIN pieces p USING (session, n) GROUP BY w.session, w.chunk),
parts AS MATERIALIZED (
  SELECT session, chunk, i AS part, seq, CASE WHEN i = 0 THEN question ELSE '' END AS question,
    substr(text, i * 1500 + 1, 1500) AS text
  FROM (SELECT *, unnest(range((length(text) + 1499) // 1500)) AS i FROM chunks))"""


@registry.add(
    "raw_blocks",
    f"{_RAW} SELECT session, chunk, part, seq, length(question) AS question_chars, text FROM parts",
)
def raw_blocks(spark, sf_dir):
    kept = turns.conversation_turns(conversation_events(spark, sf_dir))
    return packing.raw_blocks(kept, "session").select(
        "session", "chunk", F.col("part").cast("bigint").alias("part"), "seq",
        F.length("question").cast("bigint").alias("question_chars"), "text",
    )


@registry.add(
    "stride_sample",
    f"""{_RAW},
sized AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY chunk, part) - 1 AS i,
  count(*) OVER (PARTITION BY session) AS n, sum(length(text)) OVER (PARTITION BY session) AS chars FROM parts),
kept AS (SELECT *, greatest(1, n * 2500 // chars) AS keep FROM sized),
picks AS (SELECT DISTINCT session, least(n - 1, floor(k * (n::DOUBLE / keep))) AS i
  FROM (SELECT session, n, keep, unnest(range(CAST(keep AS BIGINT))) AS k FROM kept WHERE i = 0))
SELECT session, chunk, part, length(text) AS chars FROM kept
WHERE chars <= 2500 OR EXISTS (SELECT 1 FROM picks p WHERE p.session = kept.session AND p.i = kept.i)""",
)
def stride_sample(spark, sf_dir):
    kept = turns.conversation_turns(conversation_events(spark, sf_dir))
    return packing.raw_blocks(kept, "session", cap=2500).select(
        "session", "chunk", F.col("part").cast("bigint").alias("part"),
        F.length("text").cast("bigint").alias("chars"),
    )


# Pages as tool results: the page id is the call id, its language path the session.
_CALL_SQL = """calls AS (SELECT page_id // 100 AS session, page_id AS call_id, page_id * 2 AS seq,
  CASE page_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' WHEN 2 THEN 'web_fetch' ELSE 'bash' END AS name, url
  FROM pages WHERE contains(url, '?')),
results AS (SELECT page_id // 100 AS session, page_id AS call_id, page_id * 2 + 1 AS seq, page_id % 11 = 0 AS is_error, html FROM pages),
paired AS MATERIALIZED (SELECT r.*, coalesce(c.name, '') AS name,
    coalesce(array_to_string(list_slice(string_split(c.url, '/'), -2, -1), '/'), c.name, '') AS target
  FROM results r LEFT JOIN calls c USING (session, call_id))"""


def _tool_tables(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("session", F.expr("page_id div 100"))
    name = (
        F.when(F.col("page_id") % 4 == 0, "read").when(F.col("page_id") % 4 == 1, "grep")
        .when(F.col("page_id") % 4 == 2, "web_fetch").otherwise("bash")
    )
    calls = pages.where("contains(url, '?')").select(
        "session", F.col("page_id").alias("call_id"), (F.col("page_id") * 2).alias("seq"),
        name.alias("name"), F.to_json(F.struct("url")).alias("args"),
    )
    results = pages.select(
        "session", F.col("session").alias("compaction"), F.col("page_id").alias("call_id"),
        (F.col("page_id") * 2 + 1).alias("seq"), (F.col("page_id") % 11 == 0).alias("is_error"),
        F.col("html").alias("text"),
    )
    return results, calls


@registry.add(
    "tool_call_pairing",
    f"WITH {_CALL_SQL} SELECT session, call_id, seq, is_error, name, target FROM paired",
)
def tool_call_pairing(spark, sf_dir):
    paired = tools.pair_calls(*_tool_tables(spark, sf_dir))
    return paired.select(
        "session", "call_id", "seq", "is_error", "name",
        tools.tool_target(F.col("name"), F.col("args")).alias("target"),
    )


@registry.add(
    "tool_blocks",
    f"""WITH RECURSIVE {_CALL_SQL},
usable AS (SELECT *, {S.trim('html')} AS clean, '【工具 ' || name || ' 的结果 · ' || target || '】' || chr(10) AS header
  FROM paired WHERE NOT is_error AND name IN ('read', 'grep', 'web_fetch') AND {S.trim('html')} <> ''),
sized AS (SELECT *, greatest(1, 4000 - length(header)) AS room,
  '…（原 ' || length(clean) || ' 字符，已截断）' AS note FROM usable),
texts AS (SELECT *, substr(header || CASE WHEN length(clean) <= room THEN clean
    ELSE substr(clean, 1, greatest(1, room - length(note))) || note END, 1, 4000) AS text FROM sized),
items AS MATERIALIZED (SELECT *, length(text) AS chars, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM texts),
walk AS (
  SELECT session, n, CASE WHEN chars <= 20000 THEN chars ELSE 0 END AS used, chars <= 20000 AS kept FROM items WHERE n = 1
  UNION ALL
  SELECT i.session, i.n, CASE WHEN w.used + i.chars <= 20000 THEN w.used + i.chars ELSE w.used END, w.used + i.chars <= 20000
  FROM walk w JOIN items i ON i.session = w.session AND i.n = w.n + 1)
SELECT i.session, i.seq, i.name, i.target, substr('工具 ' || i.name || '：' || i.target, 1, 60) AS title, i.text, length(i.clean) > i.room AS truncated
FROM items i JOIN walk w USING (session, n) WHERE w.kept""",
)
def tool_blocks(spark, sf_dir):
    results, calls = _tool_tables(spark, sf_dir)
    return tools.tool_blocks(results, calls, "compaction", max_chars=4000, budget=20_000).select(
        "session", "seq", "name", "target", "title", "text", "truncated"
    )


@registry.add(
    "ingest_counters",
    f"""WITH {_CALL_SQL} SELECT session, count(*) AS results,
  count(*) FILTER (WHERE is_error OR name NOT IN ('read', 'grep', 'web_fetch')) AS skipped,
  count(*) FILTER (WHERE NOT is_error AND name IN ('read', 'grep', 'web_fetch')) AS usable,
  CAST(sum(length(html)) AS BIGINT) AS chars FROM paired GROUP BY session""",
)
def ingest_counters(spark, sf_dir):
    ok = ~F.col("is_error") & tools.allowed_tool(F.col("name"))
    return tools.pair_calls(*_tool_tables(spark, sf_dir)).groupBy("session").agg(
        F.count("*").alias("results"), F.count_if(~ok).alias("skipped"),
        F.count_if(ok).alias("usable"), F.sum(F.length("text")).alias("chars"),
    )
