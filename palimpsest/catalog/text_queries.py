"""Scalar text operators over whole documents, pages, questions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import parsing as P
from palimpsest.functions import sanitize as Z
from palimpsest.functions import sentences as N
from palimpsest.functions import timewords as W
from palimpsest.functions import titles as T
from palimpsest.functions import tokens as K
from palimpsest.functions.counting import text_tokens
from palimpsest.operators.records import keywords_by_id
from palimpsest.sources.tables import table

registry = Registry()


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _digest(col):
    return F.sha1(F.array_join(F.sort_array(col), " "))


def _big(col):
    return col.cast("bigint")


_TOKEN_SQL = """SELECT doc_id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct,
  sha1(array_to_string(list_sort(toks), ' ')) AS digest, CAST(fl AS BIGINT) AS floor FROM toks"""


def _token_rows(df):
    return df.withColumn("toks", text_tokens(F.col("text"))).select(
        "doc_id", _big(F.size("toks")).alias("n_tokens"),
        _big(F.size(F.array_distinct("toks"))).alias("n_distinct"),
        _digest(F.col("toks")).alias("digest"),
        _big(K.evidence_floor(F.col("text"))).alias("floor"),
    )


@registry.add(
    "tokens",
    f"WITH toks AS MATERIALIZED (SELECT doc_id, {S.tokens('text')} AS toks, "
    f"{S.floor_terms('text')} AS fl FROM documents) {_TOKEN_SQL}",
)
def tokens(spark, sf_dir):
    return _token_rows(_docs(spark, sf_dir))


_HAN = ("abcdefghijklm", "的天气预报结论决定确一了")


@registry.add(
    "cjk_tokens",
    f"WITH src AS (SELECT doc_id, translate(lower(text), '{_HAN[0]}', '{_HAN[1]}') AS text FROM documents), "
    f"toks AS MATERIALIZED (SELECT doc_id, {S.tokens('text')} AS toks, "
    f"{S.floor_terms('text')} AS fl FROM src) {_TOKEN_SQL}",
)
def cjk_tokens(spark, sf_dir):
    """Documents with half the alphabet mapped to CJK characters, whole texts."""
    df = _docs(spark, sf_dir)
    return _token_rows(df.withColumn("text", F.translate(F.lower("text"), *_HAN)))


@registry.add(
    "token_estimate",
    f"""WITH src AS (SELECT doc_id, text, translate(lower(text), '{_HAN[0]}', '{_HAN[1]}') AS han FROM documents)
SELECT doc_id, {S.estimate('text')}::BIGINT AS est, {S.estimate('han')}::BIGINT AS han_est FROM src""",
)
def token_estimate(spark, sf_dir):
    df = _docs(spark, sf_dir).withColumn("han", F.translate(F.lower("text"), *_HAN))
    return df.select(
        "doc_id", _big(K.estimate_tokens(F.col("text"))).alias("est"),
        _big(K.estimate_tokens(F.col("han"))).alias("han_est"),
    )


@registry.add(
    "title_extract",
    f"WITH {S.title_ctes('documents', 'doc_id', 'text', 'titles')} SELECT doc_id, title FROM titles",
)
def title_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.title_of(F.col("text")).alias("title"))


@registry.add(
    "keyword_topk",
    f"""WITH src AS (SELECT doc_id, text, '' AS title FROM documents),
{S.keyword_ctes('src', 'doc_id', 'text', 'title', '8', 'kw')}
SELECT doc_id, array_to_string(keywords, ' ') AS keywords FROM kw""",
)
def keyword_topk(spark, sf_dir):
    df = _docs(spark, sf_dir).withColumn("title", F.lit(""))
    return keywords_by_id(df, "doc_id", "text", "title", F.lit(8)).select(
        "doc_id", F.array_join("keywords", " ").alias("keywords")
    )


_MARKED_SQL = """marked AS (SELECT doc_id, replace(replace(replace(replace(text, ' und ', ' 决定 '),
  ' of ', ' 必须 '), ' la ', ' 默认 '), ' de ', ' 方案 ') AS text FROM documents)"""


def _marked(spark, sf_dir):
    text = F.col("text")
    for word, mark in [(" und ", " 决定 "), (" of ", " 必须 "), (" la ", " 默认 "), (" de ", " 方案 ")]:
        text = F.replace(text, F.lit(word), F.lit(mark))
    return _docs(spark, sf_dir).withColumn("text", text)


@registry.add(
    "conclusion_score",
    f"WITH {_MARKED_SQL} SELECT doc_id, {S.conclusion('text')} AS score, "
    f"{S.conclusion('text')} > 0 AS is_conclusion FROM marked",
)
def conclusion_score(spark, sf_dir):
    return _marked(spark, sf_dir).select(
        "doc_id", K.conclusion_score(F.col("text")).alias("score"),
        K.is_conclusion(F.col("text")).alias("is_conclusion"),
    )


_STOPS_SQL = "src AS (SELECT doc_id, replace(text, '. ', '! ') AS text FROM documents)"


@registry.add(
    "sentence_split",
    f"""WITH {_STOPS_SQL}, ss AS MATERIALIZED (SELECT doc_id, {S.sentences('text')} AS s FROM src)
SELECT doc_id, len(s) AS n, sha1(array_to_string(s, chr(10))) AS digest FROM ss""",
)
def sentence_split(spark, sf_dir):
    df = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("! ")))
    return df.select("doc_id", N.split_sentences(F.col("text")).alias("s")).select(
        "doc_id", _big(F.size("s")).alias("n"), F.sha1(F.array_join("s", "\n")).alias("digest")
    )


def _collapse_sql(x: str) -> str:
    arms = " ".join(
        f"WHEN length({x}) % {k} = 0 AND length({x}) // {k} >= 8 AND "
        f"repeat(substr({x}, 1, length({x}) // {k}), {k}) = {x} THEN substr({x}, 1, length({x}) // {k})"
        for k in range(2, 13)
    )
    return f"CASE WHEN length({x}) < 24 THEN {x} {arms} ELSE {x} END"


@registry.add(
    "repeat_fold",
    f"""WITH src AS (SELECT doc_id, repeat(replace(text, '. ', '! ') || '!', 1 + doc_id % 4) AS text FROM documents),
ss AS MATERIALIZED (SELECT doc_id, text, {S.sentences('text')} AS s FROM src),
kept AS (SELECT doc_id, text, s, array_to_string(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), ' ') AS j FROM ss)
SELECT doc_id, sha1(CASE WHEN len(s) < 2 THEN text ELSE {_collapse_sql('j')} END) AS folded FROM kept""",
)
def repeat_fold(spark, sf_dir):
    text = F.expr("repeat(replace(text, '. ', '! ') || '!', cast(1 + doc_id % 4 as int))")
    return _docs(spark, sf_dir).select(
        "doc_id", F.sha1(N.fold_adjacent_sentences(text)).alias("folded")
    )


@registry.add(
    "head_tail_sample",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text
  ELSE substr(text, 1, 224) || '…' || right(text, 75) END AS sample FROM documents""",
)
def head_tail_sample(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", N.sample_head_tail(F.col("text"), 300).alias("sample")
    )


@registry.add(
    "snippet",
    f"SELECT page_id, {S.clip('html', 60)} AS snippet, {S.clip('html', 120)} AS preview FROM pages",
)
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.snippet(F.col("html")).alias("snippet"), T.preview(F.col("html")).alias("preview")
    )


@registry.add(
    "time_label",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events",
)
def time_label(spark, sf_dir):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", T.time_label(at).alias("label"))


@registry.add(
    "fingerprints",
    "SELECT doc_id, substr(sha1('raw' || chr(0) || text), 1, 16) AS fp, "
    "substr(sha256(text), 1, 8) AS short FROM documents",
)
def fingerprints(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", K.fingerprint(F.lit("raw"), F.col("text")).alias("fp"),
        K.short_hash(F.col("text")).alias("short"),
    )


_PHRASE = ("CASE doc_id % 6 WHEN 0 THEN 'Just  now ' WHEN 1 THEN '之前 ' WHEN 2 THEN 'the first time ' "
           "WHEN 3 THEN '刚才 and previously ' WHEN 4 THEN 'BEFOREHAND ' ELSE '' END")


@registry.add(
    "time_shape",
    f"WITH src AS (SELECT doc_id, {_PHRASE} || text AS text FROM documents) "
    f"SELECT doc_id, coalesce({S.time_shape('text')}, '') AS shape FROM src",
)
def time_shape(spark, sf_dir):
    text = F.concat(F.expr(_PHRASE), F.col("text"))
    return _docs(spark, sf_dir).select(
        "doc_id", F.coalesce(W.time_shape(text), F.lit("")).alias("shape")
    )


_INJECT_SQL = """src AS (SELECT doc_id, replace(replace(replace(replace(text, ' und ', chr(10) || chr(10) || '⟦mem-hist⟧ '),
  ' de ', ' ⟦ /mem-hist ⟧ '), ' of ', chr(10) || ' ⟦mem-hist⟧'), ' la ', chr(10) || ' 【本次会话更早') AS text FROM documents)"""
_MARK = S.q(V.MARKER_PATTERN.replace("[WS]", f"[{V.WS}]"))
_MARK_START = S.q(f"^[{V.WS}]*" + V.MARKER_PATTERN.replace("[WS]", f"[{V.WS}]"))
_STRIP_SQL = f"""CASE WHEN contains(text, '⟦') THEN {S.trim(
    "array_to_string(list_transform(list_filter(string_split(array_to_string(list_filter("
    "string_split_regex(text, '\n{2,}'), lambda p: NOT regexp_matches(p, " + _MARK_START + ")), "
    "chr(10) || chr(10)), chr(10)), lambda x: NOT regexp_matches(x, " + _MARK_START + ")), "
    "lambda x: regexp_replace(x, " + _MARK + ", '[mem-hist]', 'g')), chr(10))")} ELSE text END"""


def _injected(spark, sf_dir):
    text = F.col("text")
    for word, mark in [
        (" und ", "\n\n⟦mem-hist⟧ "), (" de ", " ⟦ /mem-hist ⟧ "), (" of ", "\n ⟦mem-hist⟧"),
        (" la ", "\n 【本次会话更早"),
    ]:
        text = F.replace(text, F.lit(word), F.lit(mark))
    return _docs(spark, sf_dir).withColumn("text", text)


@registry.add(
    "marker_strip", f"WITH {_INJECT_SQL} SELECT doc_id, {_STRIP_SQL} AS text FROM src"
)
def marker_strip(spark, sf_dir):
    return _injected(spark, sf_dir).select("doc_id", Z.strip_markers(F.col("text")).alias("text"))


_FINGER = " OR ".join(f"contains(x, {S.q(n)})" for n in V.HEADER_FINGERPRINTS)
_FAKE = S.q(f"^[{V.WS}]*" + V.FAKE_HEADER_PREFIX)


@registry.add(
    "header_neutralise",
    f"""WITH src AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  【本次会话更早 x' || chr(10) ELSE '' END ||
  replace(replace(text, ' und ', chr(10) || '以下内容来自本会话早前（已被压缩）的部分，仅供参照 ' || chr(10)),
    ' la ', chr(10) || ' 【本次会话更早') AS x FROM documents),
lined AS (SELECT doc_id, x, {_FINGER} OR regexp_matches(x, {_FAKE}) AS sus, string_split(x, chr(10)) AS ls FROM src)
SELECT doc_id, regexp_replace(CASE WHEN sus THEN array_to_string(list_transform(ls, lambda x:
  CASE WHEN {_FINGER} THEN '{V.HEADER_REMOVED}' ELSE regexp_replace(x, {_FAKE}, '{V.FAKE_HEADER_REPLACEMENT}') END), chr(10))
  ELSE x END, {_MARK}, '[mem-hist]', 'g') AS text FROM lined""",
)
def header_neutralise(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 2 == 0, "  【本次会话更早 x\n").otherwise("")
    body = F.replace("text", F.lit(" und "), F.lit("\n以下内容来自本会话早前（已被压缩）的部分，仅供参照 \n"))
    body = F.replace(body, F.lit(" la "), F.lit("\n 【本次会话更早"))
    return _docs(spark, sf_dir).select(
        "doc_id", Z.neutralize_headers(F.concat(lead, body)).alias("text")
    )


@registry.add(
    "line_predicates",
    rf"""WITH ls AS (SELECT doc_id, unnest({S.lines('text')}) AS x FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST({S.continuation('x')} AS INTEGER)) AS BIGINT) AS continuations,
  CAST(sum(CAST(length(x) - length(replace(x, '|', '')) >= 3 OR contains(x, '---') AS INTEGER)) AS BIGINT) AS table_rows,
  CAST(sum(CAST(length(x) < 6 OR regexp_matches(x, '[,，、;；:：]$') OR
    regexp_matches(x, '(?i)(into|and|via|with|to|for|of|the)$') OR regexp_matches(x, '^[)\]）】]') OR
    length(regexp_replace(x, '[^（(]', '', 'g')) <> length(regexp_replace(x, '[^）)]', '', 'g')) AS INTEGER)) AS BIGINT) AS fragments,
  CAST(sum(CAST(length(x) >= 120 AS INTEGER)) AS BIGINT) AS expandable
FROM ls GROUP BY doc_id""",
)
def line_predicates(spark, sf_dir):
    x = F.col("x")
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(T.nonblank_lines(F.col("text"))).alias("x"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(T.is_continuation(x)).alias("continuations"),
        F.count_if(T.is_table_row(x)).alias("table_rows"),
        F.count_if(T.is_fragment_title(x)).alias("fragments"),
        F.count_if(F.length(x) >= 120).alias("expandable"),
    )


@registry.add(
    "concentration",
    """WITH src AS (SELECT item_id, text, list_concat(list_filter(string_split(text, ' '), lambda t: trim(t) <> ''), ['zzz', right(text, 8)]) AS ts FROM benchmark),
pos AS MATERIALIZED (SELECT item_id, text, list_sort(list_filter(list_transform(ts, lambda t: instr(text, trim(t)) - 1), lambda p: p >= 0)) AS ps, len(ts) AS nt FROM src)
SELECT item_id, len(ps) AS hits, nt - len(ps) AS missing, ps[1] AS first, ps[len(ps)] AS last,
  ps[len(ps)] - ps[1] AS span, round((ps[len(ps)] - ps[1]) / length(text), 4) AS span_ratio,
  len(list_filter(ps, lambda p, i: i > 1 AND p - ps[i - 1] > 20)) + 1 AS clusters FROM pos""",
)
def concentration(spark, sf_dir):
    terms = F.expr("concat(filter(split(text, ' '), t -> trim(t) <> ''), array('zzz', right(text, 8)))")
    out = table(spark, sf_dir, "benchmark").select(
        "item_id", P.concentration(F.col("text"), terms, gap=20).alias("c")
    )
    return out.select(
        "item_id", *(_big(F.col(f"c.{f}")).alias(f) for f in
                     ("hits", "missing", "first", "last", "span", "clusters")), "c.span_ratio"
    )


_ANSWER = """CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN ' ' || CAST(doc_id % 40 AS {s}) || ' '
  WHEN 3 THEN '7 and 8' WHEN 4 THEN CAST(doc_id % 31 AS {s}) || ' earliest' WHEN 5 THEN 'NONE both_ends'
  WHEN 6 THEN 'pick 3 recent none' WHEN 7 THEN '5 earliest_first' ELSE 'earliest recent 2' END"""


@registry.add(
    "page_pick_parse",
    f"""WITH src AS (SELECT doc_id, {_ANSWER.format(s='VARCHAR')} AS a FROM labels),
x AS (SELECT doc_id, trim(a) AS a, regexp_extract_all(trim(a), '[0-9]+') AS ns,
  list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(a, '\\bNONE\\b', ' ', 'g')), '[a-z_]+'),
    lambda w: w IN ('earliest', 'recent', 'both_ends', 'none'))) AS ws FROM src),
y AS (SELECT *, CASE WHEN a = '' THEN 'empty' WHEN regexp_matches(a, '(?i)\\bNONE\\b') THEN 'none'
  WHEN len(ns) = 1 AND CAST(ns[1] AS BIGINT) BETWEEN 1 AND 30 THEN 'found' ELSE 'unclear' END AS kind FROM x)
SELECT doc_id, kind, CASE WHEN kind = 'found' THEN CAST(ns[1] AS BIGINT) ELSE 0 END AS index,
  coalesce(CASE WHEN len(ws) = 1 THEN ws[1] WHEN len(ws) > 1 AND len(list_filter(ws, lambda w: w <> 'none')) = 1
    THEN list_filter(ws, lambda w: w <> 'none')[1] END, '') AS intent FROM y""",
)
def page_pick_parse(spark, sf_dir):
    answer = F.expr(_ANSWER.format(s="STRING"))
    return table(spark, sf_dir, "labels").withColumn("a", answer).select(
        "doc_id", P.page_pick(F.col("a"), F.lit(30)).alias("p"),
        F.coalesce(P.page_intent(F.col("a")), F.lit("")).alias("intent"),
    ).select("doc_id", "p.kind", "p.index", "intent")


@registry.add(
    "loose_json",
    """WITH src AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'answer: ' || props || ' done' WHEN 1 THEN props
  ELSE 'broken {' || event_type END AS raw, event_type FROM events)
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(regexp_extract(raw, '\\{.*\\}'), '$.k') AS BIGINT) END IS NOT NULL AS is_object,
  coalesce(CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(regexp_extract(raw, '\\{.*\\}'), '$.k') AS BIGINT) END, -1) AS k FROM src""",
)
def loose_json(spark, sf_dir):
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN 'answer: ' || props || ' done' WHEN 1 THEN props
      ELSE 'broken {' || event_type END""")
    obj = table(spark, sf_dir, "events").select("event_id", P.loose_object(raw).alias("o"))
    return obj.select(
        "event_id", F.col("o").isNotNull().alias("is_object"),
        F.coalesce(F.try_variant_get("o", "$.k", "bigint"), F.lit(-1)).alias("k"),
    )


@registry.add(
    "rewrite_parse",
    """WITH w AS (SELECT item_id, string_split_regex(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +') AS ws FROM benchmark),
t AS (SELECT item_id, list_slice(list_filter(list_transform(ws, lambda x: substr(x, 1, 24)), lambda x: x <> ''), 1, 12) AS ts FROM w)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'topic' ELSE '' END AS point, array_to_string(ts, ' ') AS terms,
  CASE WHEN item_id % 2 = 0 THEN 'recent' ELSE 'none' END AS intent FROM t""",
)
def rewrite_parse(spark, sf_dir):
    words = F.expr("split(regexp_replace(text, '[^A-Za-z ]', ' '), ' +')")
    listed = F.to_json(words)
    raw = F.when(
        F.col("item_id") % 2 == 0,
        F.concat(F.lit('so: {"点": " topic ", "关键词": '), listed, F.lit(', "时间意图": "Recent"} ok')),
    ).otherwise(F.concat(F.lit("list "), listed))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", P.focused_rewrite(raw).alias("r")
    ).select("item_id", "r.point", F.array_join("r.terms", " ").alias("terms"), "r.intent")


@registry.add(
    "keyword_merge",
    """WITH w AS (SELECT item_id, string_split(text, ' ') AS a, string_split(lower(text), ' ') AS b FROM benchmark),
m AS (SELECT item_id, list_filter(list_concat(a, b), lambda x: x <> '') AS ws FROM w)
SELECT item_id, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 10), ' ') AS merged FROM m""",
)
def keyword_merge(spark, sf_dir):
    merged = P.merged_keywords(
        F.expr("split(text, ' ')"), F.expr("split(lower(text), ' ')")
    )
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(merged, " ").alias("merged"))


@registry.add(
    "session_names",
    f"""SELECT page_id, substr(regexp_replace('session-' || url, '^session-', ''), 1, 8) AS short,
  substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 120) AS safe,
  CASE WHEN page_id % 3 = 0 THEN 'T' || CAST(page_id AS VARCHAR) ELSE {S.clip('url', 28)} END AS title,
  CASE WHEN page_id % 2 = 0 THEN '工具结果(read)' ELSE '对话' END AS label FROM pages""",
)
def session_names(spark, sf_dir):
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string")))
    src = F.when(F.col("page_id") % 2 == 0, "tool")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.short_session_id(F.concat(F.lit("session-"), "url")).alias("short"),
        T.safe_session_id(F.col("url")).alias("safe"),
        T.session_title(own, F.col("url"), F.lit("none")).alias("title"),
        T.source_label(src, F.lit("read")).alias("label"),
    )
