"""Miss diagnosis and history reading."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.event_queries import TURNS
from palimpsest.catalog.search_queries import _index, stored_records
from palimpsest.operators import diagnose as D
from palimpsest.operators import turns as T
from palimpsest.operators.ordered import top_per_key
from palimpsest.operators.rollups import score_bands
from palimpsest.operators.search import query_terms, search
from palimpsest.session import offered
from palimpsest.sources.tables import conversation_events, document_blocks, questions, table

registry = Registry()

# Every question is asked in one session, chosen by its id.
_ASKED = """asked AS (SELECT item_id AS query_id, 0 AS segment, 'src' || (item_id % 20) AS session,
  text FROM benchmark)"""


def asked(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", "session", "text")


_COVER = f"""qt AS MATERIALIZED (SELECT query_id, session, unnest(list_distinct({S.tokens('text')})) AS token FROM asked),
cov AS MATERIALIZED (SELECT a.query_id, a.session, count(q.token) AS total, count(t.token) AS present,
    count(q.token) FILTER (WHERE t.token IS NULL) AS missing
  FROM asked a LEFT JOIN qt q USING (query_id, session) LEFT JOIN terms t ON t.session = q.session AND t.token = q.token
  GROUP BY a.query_id, a.session)"""


@registry.add(
    "token_coverage",
    f"WITH {S.INDEX}, {_ASKED}, {_COVER} SELECT query_id, session, total, present, missing AS absent FROM cov",
)
def token_coverage(spark, sf_dir):
    return D.coverage(_index(spark, sf_dir), asked(spark, sf_dir)).withColumn(
        "absent", F.size("absent").cast("bigint")
    )


@registry.add(
    "absent_terms",
    f"""WITH {S.INDEX}, {_ASKED}, qt AS (SELECT query_id, session, unnest(list_distinct({S.tokens('text')})) AS token FROM asked)
SELECT query_id, session, token FROM qt WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.session = qt.session AND t.token = qt.token)""",
)
def absent_terms(spark, sf_dir):
    """Set difference: the question's tokens that its session does not know."""
    terms = query_terms(asked(spark, sf_dir)).select("query_id", "session", "token")
    return terms.join(_index(spark, sf_dir).terms_of(terms), ["session", "token"], "left_anti").select(
        "query_id", "session", "token"
    )


@registry.add(
    "coverage_verdict",
    f"""WITH {S.INDEX}, {_ASKED}, {_COVER}, {S.search_ctes('asked', by_layer=False, limit=1)},
lost AS MATERIALIZED (SELECT DISTINCT 'src' || (conv_id % 20) AS session, unnest({S.tokens('text')}) AS token FROM conversations)
SELECT c.query_id, c.session, c.total, c.present, floor(coalesce(h.score, 0) * 10000 + 0.5) / 10000 AS best,
  CASE WHEN c.present = 0 AND EXISTS (SELECT 1 FROM qt q JOIN lost l USING (session, token)
      WHERE q.query_id = c.query_id AND q.session = c.session) THEN 'not-ingested' WHEN c.present = 0 THEN 'absent'
    WHEN floor(coalesce(h.score, 0) * 10000 + 0.5) / 10000 < 0.28 THEN 'scattered' ELSE 'above-threshold' END AS verdict
FROM cov c LEFT JOIN hits h USING (query_id, session)""",
)
def coverage_verdict(spark, sf_dir):
    ask = asked(spark, sf_dir)
    session = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    dropped = table(spark, sf_dir, "conversations").select(session.alias("session"), "text")
    out = D.verdicts(_index(spark, sf_dir), ask, dropped=dropped)
    return out.select("query_id", "session", "total", "present", "best", "verdict")


@registry.add(
    "token_spread",
    f"""WITH {S.RECORDS}, {_ASKED},
qt AS MATERIALIZED (SELECT query_id, session, t AS token, min(i) AS pos FROM (SELECT query_id, session, unnest({S.tokens('text')}) AS t,
    unnest(range(len({S.tokens('text')}))) AS i FROM asked) GROUP BY ALL HAVING TRUE),
first AS (SELECT query_id, session, token, min(pos) AS pos FROM qt GROUP BY ALL),
cnt AS (SELECT f.query_id, f.session, f.token, min(f.pos) AS pos, count(r.ord) AS records FROM (SELECT query_id, session, token, min(pos) AS pos FROM first GROUP BY query_id, session, token) f
  LEFT JOIN records r ON r.session = f.session AND contains(r.title || chr(10) || array_to_string(r.keywords, ' ') || chr(10) || r.text, f.token)
  WHERE length(f.token) > 1 GROUP BY f.query_id, f.session, f.token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY records DESC, pos) AS place FROM cnt)
SELECT query_id, session, token, records, place FROM ranked WHERE place <= 12""",
)
def token_spread(spark, sf_dir):
    out = D.token_spread(stored_records(spark, sf_dir), asked(spark, sf_dir))
    return out.select(
        "query_id", "session", "token", "records", F.col("place").cast("bigint").alias("place")
    )


_POOL = f"""WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=False, limit=120)},
pool AS (SELECT h.*, h.rank AS place, r.text FROM hits h JOIN kept r USING (session, ord))"""


def _pool(spark, sf_dir):
    hits = search(_index(spark, sf_dir), questions(spark, sf_dir), limit=120)
    texts = document_blocks(spark, sf_dir).select("session", "ord", "text")
    return offered(D.candidate_pool(hits)).join(texts, ["session", "ord"])


@registry.add(
    "page_breaks",
    f"""{_POOL},
laid AS (SELECT query_id, session, ord, place, (place - 1) // 10 AS page, {S.clip('title', 40)} AS title, {S.clip('text', 60)} AS snippet,
  replace(left("at", 16), 'T', ' ') AS time FROM pool),
costed AS (SELECT *, length(title) + length(snippet) + length(time) + 12 AS cost,
  row_number() OVER (PARTITION BY query_id, session, page ORDER BY place) AS number FROM laid),
summed AS (SELECT *, sum(cost) OVER (PARTITION BY query_id, session, page ORDER BY place) AS s FROM costed)
SELECT query_id, session, ord, page, number, cost, number = 1 OR s <= 600 AS shown,
  '[' || number || '] ' || time || ' · ' || title || '：' || snippet AS line FROM summed""",
)
def page_breaks(spark, sf_dir):
    laid = D.pages(_pool(spark, sf_dir), page_size=10, max_chars=600)
    return laid.select(
        "query_id", "session", "ord", F.col("page").cast("bigint").alias("page"),
        F.col("number").cast("bigint").alias("number"), F.col("cost").cast("bigint").alias("cost"),
        "shown", "line",
    )


@registry.add(
    "page_pick_loop",
    """WITH a AS (SELECT conv_id AS query_id, 's' AS session, turn AS page, length(text) % 9 AS items, turn <> 3 AS ok,
  CASE WHEN length(text) % 4 = 0 THEN CAST(length(text) % 7 AS VARCHAR) ELSE 'NONE recent' END AS answer FROM conversations),
s AS (SELECT *, CASE WHEN regexp_matches(answer, '^[0-9]+$') AND CAST(regexp_extract(answer, '[0-9]+') AS INTEGER) BETWEEN 1 AND items THEN 'found' ELSE 'no' END AS kind
  FROM (SELECT query_id, session, page, items, ok, answer FROM a WHERE page < 4 AND items > 0)),
e AS (SELECT query_id, session, min(CASE WHEN NOT ok OR kind = 'found' THEN page END) AS stop, count(*) AS pages,
  arg_min(CASE WHEN answer = 'NONE recent' THEN 'recent' ELSE '' END, page) AS intent FROM s GROUP BY ALL)
SELECT e.query_id, e.session, coalesce(s.ok, FALSE) AS found, CASE WHEN s.ok THEN CAST(s.answer AS BIGINT) ELSE 0 END AS index,
  coalesce(e.stop, e.pages - 1) + 1 AS page,
  (SELECT count(*) FROM s x WHERE x.query_id = e.query_id AND (e.stop IS NULL OR x.page <= e.stop)) AS asked, e.intent
FROM e LEFT JOIN s ON s.query_id = e.query_id AND s.page = e.stop""",
)
def page_pick_loop(spark, sf_dir):
    """Page answers derived from conversation rows: one page per turn."""
    n = F.length("text")
    answers = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("query_id"), F.lit("s").alias("session"), F.col("turn").alias("page"),
        (n % 9).alias("items"), (F.col("turn") != 3).alias("ok"),
        F.when(n % 4 == 0, (n % 7).cast("string")).otherwise("NONE recent").alias("answer"),
    )
    return D.pick_across_pages(answers).withColumn("intent", F.coalesce("intent", F.lit("")))


@registry.add(
    "score_bands",
    f"""WITH {S.INDEX}, {S.QUESTIONS}, {S.search_ctes('questions', by_layer=False, limit=1)}
SELECT CAST(floor(score / 0.1 + 1e-9) AS BIGINT) AS band, count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high FROM hits GROUP BY 1""",
)
def score_bands_query(spark, sf_dir):
    best = search(_index(spark, sf_dir), questions(spark, sf_dir), limit=1)
    return score_bands(best, "score").withColumns(
        {"low": F.round("low", 6), "high": F.round("high", 6)}
    )


@registry.add(
    "history_last",
    f"""WITH {S.BLOCKS}, r AS (SELECT session, ord, text, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS back FROM blocks WHERE layer = 'raw'),
p AS (SELECT session, ord, text, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM r WHERE back <= 5),
c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY session ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT session AS key, ord, place, substr(text, 1, CAST(12000 - before AS BIGINT)) AS text FROM c WHERE before < 12000""",
)
def history_last(spark, sf_dir):
    raw = document_blocks(spark, sf_dir).where("layer = 'raw'").select("session", "ord", "text")
    last = top_per_key(raw, ["session"], [F.desc("ord")], 5, "back")
    w = Window.partitionBy("session").orderBy("ord")
    placed = last.withColumn("place", F.row_number().over(w)).withColumnRenamed("session", "key")
    return D.history(placed).select("key", "ord", F.col("place").cast("bigint").alias("place"), "text")


@registry.add(
    "history_turns",
    f"""WITH {TURNS}, q AS (SELECT session, arg_max({S.trim('text')}, seq) AS text FROM ev WHERE type = 'user/message' AND kind = 'user' AND {S.trim('text')} <> '' GROUP BY session),
s AS MATERIALIZED (SELECT t.session, t.turn_no, list_distinct({S.tokens('q.text')}) AS a, list_distinct({S.tokens("t.user || chr(10) || t.assistant")}) AS b FROM turns t JOIN q USING (session)),
j AS (SELECT session, turn_no, round({S.jaccard('a', 'b')}, 9) AS score FROM s)
SELECT session, turn_no, round(score, 6) AS score, row_number() OVER (PARTITION BY session ORDER BY score DESC, turn_no) AS place FROM j WHERE score > 0 QUALIFY place <= 5""",
)
def history_turns(spark, sf_dir):
    events = conversation_events(spark, sf_dir)
    ask = T.last_questions(events, 1).select("session", F.col("latest").alias("text"))
    out = D.similar_turns(T.conversation_turns(events), ask)
    return out.select(
        "session", "turn_no", F.round("score", 6).alias("score"),
        F.col("place").cast("bigint").alias("place"),
    )
