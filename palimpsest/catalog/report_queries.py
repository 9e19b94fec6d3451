"""Reports over whole stores: what keyword expansion sends and spares, and time references as searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.catalog.search_queries import _index
from palimpsest.functions import timewords as W
from palimpsest.operators.rollups import expansion_savings
from palimpsest.operators.search import search
from palimpsest.sources.listing import known_workspaces
from palimpsest.sources.tables import document_blocks, table
from palimpsest.vocab import SENTENCE_END

registry = Registry()

_INK = f"regexp_replace(piece, {S.WS_RUN}, '', 'g')"
_CALLS = "calls_{way} AS (SELECT session, compaction_id, '{way}' AS way, count(*) AS targets, sum(length(piece)) + 2 * (count(*) - 1) AS chars, " + (
    "CAST(ceil((sum(length({ink})) - sum(length(regexp_replace({ink}, {cjk}, '', 'g')))) * 0.85::DOUBLE"
    " + sum(length(regexp_replace({ink}, {cjk}, '', 'g'))) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM (\n"
    "  SELECT *, '[' || (n % 5) || '] ' || substr(text, 1, 600) AS piece FROM (SELECT *, row_number() OVER (PARTITION BY session, compaction_id"
    " ORDER BY ord) - 1 AS n FROM stored WHERE length(text) >= 120{more}))\n  GROUP BY session, compaction_id, n // 5)"
)


def _calls(way: str, more: str) -> str:
    return _CALLS.format(way=way, ink=_INK, cjk=S.q(S.C + "+"), more=more)


_SUMS = ", ".join(
    f"CAST(coalesce(sum({v}) FILTER (WHERE way = '{w}'), 0) AS BIGINT) AS {n}_{w}"
    for w in ("before", "after") for n, v in (("targets", "targets"), ("calls", "1"), ("chars", "chars"), ("tokens", "tokens"))
)


@registry.add(
    "expansion_savings",
    f"""WITH {S.BLOCKS},
stored AS MATERIALIZED (SELECT session, compaction_id, ord, text, NULL AS src FROM blocks
  UNION ALL SELECT 'src' || (page_id % 20), 'src' || (page_id % 20) || '-' || (page_id // 200), 1000000000 + page_id, html, 'tool' FROM pages),
{_calls('before', '')},
{_calls('after', " AND src IS NULL")},
every AS (SELECT session, compaction_id, way, 0 AS blocks, targets, chars, tokens FROM calls_before
  UNION ALL SELECT session, compaction_id, way, 0, targets, chars, tokens FROM calls_after
  UNION ALL SELECT session, compaction_id, 'none', count(*), 0, 0, 0 FROM stored GROUP BY session, compaction_id),
rolled AS (SELECT session, compaction_id, CASE grouping(session, compaction_id) WHEN 0 THEN 'compaction' WHEN 1 THEN 'session' ELSE 'total' END AS level,
  CAST(sum(blocks) AS BIGINT) AS blocks, {_SUMS} FROM every GROUP BY ROLLUP (session, compaction_id))
SELECT level, session, compaction_id, blocks, targets_before, calls_before, chars_before, tokens_before, targets_after, calls_after,
  chars_after, tokens_after, round(1 - tokens_after / nullif(tokens_before, 0)::DOUBLE, 6) AS saved,
  round(tokens_before / nullif((SELECT tokens_before FROM rolled WHERE level = 'total'), 0)::DOUBLE, 6) AS share FROM rolled""",
)
def expansion_savings_query(spark, sf_dir):
    """Documents as blocks and pages as tool results, each with compactions of their own numbering."""
    session = F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"))
    pages = table(spark, sf_dir, "pages").select(
        session.alias("session"), F.concat_ws("-", session, F.expr("page_id div 200").cast("string")).alias("compaction_id"),
        (F.col("page_id") + 1_000_000_000).alias("ord"), F.col("html").alias("text"), F.lit("tool").alias("src"),
    )
    records = document_blocks(spark, sf_dir).select("session", "compaction_id", "ord", "text", "src").unionByName(pages)
    out = expansion_savings(records)
    return out.withColumns({"saved": F.round("saved", 6), "share": F.round("share", 6)})


@registry.add(
    "known_workspaces",
    """WITH lists AS (
  SELECT source AS w, 0 AS rank, min(doc_id) AS pos FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source
  UNION ALL SELECT source, 1, min(doc_id) FROM documents GROUP BY source
  UNION ALL SELECT 'src' || (conv_id % 25), 2, min(conv_id) FROM conversations GROUP BY 1),
first AS (SELECT w, min({'r': rank, 'p': pos}) AS at_ FROM lists WHERE w <> '' GROUP BY w)
SELECT w AS workspace, row_number() OVER (ORDER BY at_.r, at_.p, w) - 1 AS place FROM first""",
)
def known_workspaces_query(spark, sf_dir):
    """Sources of good documents first, then all sources, then those that conversations name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("workspace"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    lists = [docs.join(good, "doc_id", "left_semi"), docs]
    lists = [d.groupBy("workspace").agg(F.min("doc_id").alias("pos")) for d in lists]
    named = F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("workspace")
    talks = table(spark, sf_dir, "conversations").select(named, F.col("conv_id").alias("pos"))
    return known_workspaces([*lists, talks.groupBy("workspace").agg(F.min("pos").alias("pos"))])


_PHRASE = "(CASE {id} % 5 WHEN 0 THEN 'As discussed yesterday, ' WHEN 1 THEN '上次 ' WHEN 2 THEN 'Recently ' ELSE '' END)"
_PIECES = S.q(f"(?i)(?:{W.any_pattern()}|[^\n{SENTENCE_END}])+|[\n{SENTENCE_END}]")


def _windows(source: str, keys: str, text: str, out: str) -> str:
    """CTE ``out``: keys, n, start, end, text of the sentences of ``source`` that hold a time reference."""
    return f"""
{out}_p AS MATERIALIZED (SELECT {keys}, {text} AS whole, regexp_extract_all({text}, {_PIECES}) AS p FROM {source}),
{out}_u AS (SELECT {keys}, whole, unnest(p) AS x, unnest(range(len(p))) AS i FROM {out}_p),
{out}_o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {out}_u),
{out} AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS n,
  CAST(off + length(x) - length(ltrim(x, {S.WS})) AS BIGINT) AS start, CAST(off + length(x) - length(ltrim(x, {S.WS})) + length({S.trim('x')}) AS BIGINT) AS "end",
  {S.trim('x')} AS text FROM {out}_o WHERE regexp_matches(lower(x), {S.q(W.any_pattern())}))"""


@registry.add(
    "time_windows",
    f"""WITH src AS (SELECT doc_id, {_PHRASE.format(id='doc_id')} || replace(text, '. ', '. ' || {_PHRASE.format(id='(doc_id + 1)')}) AS text FROM documents),
{_windows('src', 'doc_id', 'text', 'w')} SELECT doc_id, n, start, "end", text FROM w""",
)
def time_windows(spark, sf_dir):
    """Sentences with a time reference in texts that have them at the start, inside, or not at all."""
    text = F.expr(f"{_PHRASE.format(id='doc_id')} || replace(text, '. ', '. ' || {_PHRASE.format(id='(doc_id + 1)')})")
    return _spans(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")


def _spans(texts, *keys):
    spans = texts.select(*keys, "text", F.posexplode(W.time_windows(F.col("text"))).alias("n", "w"))
    start, end = F.col("w.start").cast("bigint"), F.col("w.end").cast("bigint")
    cut = F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))
    return spans.select(*keys, F.col("n").cast("bigint").alias("n"), start.alias("start"), end.alias("end"), cut.alias("text"))


@registry.add(
    "time_window_hits",
    f"""WITH {S.INDEX},
src AS (SELECT item_id, {_PHRASE.format(id='item_id')} || text AS text FROM benchmark),
{_windows('src', 'item_id', 'text', 'w')},
asked AS (SELECT item_id AS query_id, n AS segment, 'src' || (item_id % 20) AS session, text FROM w),
{S.search_ctes('asked', by_layer=False, limit=3)}
SELECT query_id, segment, session, ord, rank, round(score, 6) AS score FROM hits""",
)
def time_window_hits(spark, sf_dir):
    """Each sentence of a question that refers to a time is searched on its own."""
    text = F.expr(f"{_PHRASE.format(id='item_id')} || text")
    windows = _spans(table(spark, sf_dir, "benchmark").select("item_id", text.alias("text")), "item_id")
    session = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    asked = windows.select(F.col("item_id").alias("query_id"), F.col("n").alias("segment"), session.alias("session"), "text")
    return search(_index(spark, sf_dir), asked, limit=3).select(
        "query_id", "segment", "session", "ord", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score")
    )
