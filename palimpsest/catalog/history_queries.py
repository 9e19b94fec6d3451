"""Old text read back from the store, or from the log where the store has none."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.event_queries import TURNS
from palimpsest.catalog.search_queries import stored_records
from palimpsest.operators.history import history_read
from palimpsest.operators.index import build_index
from palimpsest.operators.turns import conversation_turns, last_questions
from palimpsest.sources.tables import conversation_events

registry = Registry()

BUDGET = 3000


@registry.add(
    "history_read",
    f"""WITH {S.RECORDS}, {TURNS},
rawrecs AS MATERIALIZED (SELECT * REPLACE (CAST(doc_session AS VARCHAR) AS session) FROM (SELECT *, ord % 40 AS doc_session FROM records WHERE layer = 'raw')),
{S.index_ctes('rawrecs')},
asked AS MATERIALIZED (SELECT session AS query_id, 0 AS segment, CAST(session AS VARCHAR) AS session,
    CASE WHEN session % 7 = 0 THEN '' ELSE arg_max({S.trim('text')}, seq) END AS text
  FROM ev WHERE type = 'user/message' AND kind = 'user' AND {S.trim('text')} <> '' GROUP BY session),
named AS (SELECT * FROM asked WHERE text <> ''),
{S.search_ctes('named', by_layer=False, limit=5)},
store AS MATERIALIZED (SELECT h.query_id, h.session, h.rank AS place, r.text FROM hits h JOIN rawrecs r USING (session, ord)
  UNION ALL SELECT a.query_id, a.session, r.up, r.text FROM asked a JOIN (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS back,
      count(*) OVER (PARTITION BY session) AS n, least(n, 5) - back + 1 AS up FROM rawrecs QUALIFY back <= 5) r USING (session) WHERE a.text = ''),
missing AS MATERIALIZED (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.query_id = a.query_id)),
told AS MATERIALIZED (SELECT CAST(session AS VARCHAR) AS session, turn_no, '问：' || user || CASE WHEN assistant = '' THEN '' ELSE chr(10) || '答：' || assistant END AS text,
  list_distinct({S.tokens("user || chr(10) || assistant")}) AS own FROM turns),
scored AS (SELECT m.query_id, m.session, t.turn_no, t.text, round({S.jaccard('w', 'own')}, 9) AS score
  FROM (SELECT *, list_distinct({S.tokens('text')}) AS w FROM missing WHERE text <> '') m JOIN told t USING (session)),
logged AS (SELECT query_id, session, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, turn_no) AS place, text FROM scored WHERE score > 0 QUALIFY place <= 5
  UNION ALL SELECT m.query_id, m.session, t.up, t.text FROM missing m JOIN (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn_no DESC) AS back,
      count(*) OVER (PARTITION BY session) AS n, least(n, 5) - back + 1 AS up FROM told QUALIFY back <= 5) t USING (session) WHERE m.text = ''),
united AS (SELECT *, 'store' AS source FROM store UNION ALL SELECT *, 'log' FROM logged),
run AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id, session ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM united)
SELECT query_id, session, CAST(place AS BIGINT) AS place, source, substr(text, 1, CAST({BUDGET} - used AS INTEGER)) AS text FROM run WHERE used < {BUDGET}""",
)
def history_read_query(spark, sf_dir):
    """The last question of each conversation, asked of blocks stored for some of the conversations and of the
    conversations' own turns; every seventh asks for the latest."""
    records = stored_records(spark, sf_dir).where("layer = 'raw'").withColumn("session", (F.col("ord") % 40).cast("string"))
    events = conversation_events(spark, sf_dir)
    turns = conversation_turns(events).withColumn("session", F.col("session").cast("string"))
    asked = last_questions(events, 1).select(
        F.col("session").alias("query_id"), F.col("session").cast("string").alias("session"),
        F.when(F.col("session") % 7 == 0, "").otherwise(F.col("latest")).alias("text"),
    )
    return history_read(build_index(records).settled(), records, turns, asked, max_chars=BUDGET)
