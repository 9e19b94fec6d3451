"""Building blocks of the oracle SQL: the same definitions written for DuckDB."""

from __future__ import annotations

from palimpsest import vocab as V
from palimpsest.functions.timewords import class_pattern


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOPS = "[" + ", ".join(q(w) for w in V.STOP_WORDS) + "]"
WS = q(V.WS)
WS_RUN = q(f"[{V.WS}]+")
C = f"[{V.CJK}]"
LEAD = q(r"^[#>\-*" + V.WS + "]+")


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, {WS_RUN}, ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(V.WORD_PATTERN)})"


def surface_words(x: str) -> str:
    return (
        f"list_filter(list_transform({words(x)}, lambda w: lower(w)), "
        f"lambda w: NOT list_contains({STOPS}, w))"
    )


def parts(x: str) -> str:
    split = (
        r"string_split_regex(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-./#+ ]+')"
    )
    return (
        f"flatten(list_transform(list_filter({words(x)}, lambda w: regexp_matches(w, '^[A-Za-z]') "
        f"AND regexp_matches(w, {q(V.IDENTIFIER_BREAK)})), "
        f"lambda w: list_filter(list_distinct(list_transform({split}, lambda p: lower(p))), "
        f"lambda p: length(p) >= 2 AND p <> lower(w) AND NOT list_contains({STOPS}, p))))"
    )


def bigrams(x: str) -> str:
    pairs = (
        "CASE WHEN length(r) = 1 THEN [r] ELSE "
        "list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    )
    return (
        f"list_filter(flatten(list_transform(regexp_extract_all({x}, {q(C + '+')}), "
        f"lambda r: {pairs})), lambda b: NOT regexp_matches(b, {q(f'^[{V.STOP_CHARS}]{{1,2}}$')}))"
    )


def surface(x: str) -> str:
    return f"list_concat({surface_words(x)}, {bigrams(x)})"


def tokens(x: str) -> str:
    return f"list_concat(list_concat({surface_words(x)}, {parts(x)}), {bigrams(x)})"


def floor_terms(x: str) -> str:
    return f"least({V.EVIDENCE_FLOOR}, len(list_distinct({surface(x)})))"


def estimate(x: str) -> str:
    ink = f"regexp_replace({x}, {WS_RUN}, '', 'g')"
    other = f"length(regexp_replace({ink}, {q(C + '+')}, '', 'g'))"
    return f"CAST(ceil((length({ink}) - {other}) * 0.85::DOUBLE + {other} / 4.0::DOUBLE) AS INTEGER)"


def conclusion(x: str) -> str:
    hits = " + ".join(f"CAST(contains({x}, {q(m)}) AS INTEGER)" for m in V.CONCLUSION_MARKERS)
    return f"least(1.0::DOUBLE, ({hits}) / 4.0::DOUBLE)"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) END"
    )


def clean_line(x: str) -> str:
    return trim(f"replace(replace(regexp_replace({x}, {LEAD}, ''), '**', ''), '`', '')")


def continuation(x: str) -> str:
    return (
        f"(length({x}) < 3 OR regexp_matches({x}, '^[a-z]') "
        f"OR regexp_matches({x}, '^[)）,，。、；：;:.…\\-|*>`\\]]') "
        f"OR (regexp_matches({x}, '^[<>/]') AND length({x}) < 24))"
    )


def cut(x: str, limit: int) -> str:
    head = f"substr({x}, 1, {limit})"
    upto = f"regexp_extract({head}, '(?s)^(.*)[。；，;., ]', 1)"
    return (
        f"CASE WHEN length({x}) <= {limit} THEN {x} "
        f"WHEN length({upto}) >= {limit} * 0.4 THEN {trim(upto)} ELSE {trim(head)} END"
    )


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {trim('x')}), lambda x: x <> '')"


def title_ctes(source: str, ident: str, text: str, out: str, prefer: str = "TRUE") -> str:
    """CTEs ``{out}``: ident, title. ``prefer`` is a SQL condition for using headings."""
    mark = q(V.MARKER)
    usable = f"lambda x: x <> '' AND NOT contains(x, {mark})"
    heading = q(f"^#{{1,6}}[{V.WS}]+")
    return f"""
{out}_lines AS MATERIALIZED (SELECT {ident}, {prefer} AS prefer, {lines(text)} AS ls FROM {source}),
{out}_choices AS MATERIALIZED (
  SELECT {ident}, prefer,
    list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, {q(f'^#{{1,6}}[{V.WS}]+.')})),
      lambda x: {clean_line(f"regexp_replace(x, {heading}, '')")}), {usable}) AS heads,
    list_filter(list_transform(ls, lambda x: {clean_line('x')}), {usable}) AS cleaned
  FROM {out}_lines),
{out}_pick AS MATERIALIZED (
  SELECT {ident}, coalesce(CASE WHEN prefer THEN heads[1] END,
    list_filter(cleaned, lambda x: NOT {continuation('x')})[1], cleaned[1], '') AS t
  FROM {out}_choices),
{out} AS MATERIALIZED (SELECT {ident}, {cut('t', 40)} AS title FROM {out}_pick)"""


def keyword_ctes(source: str, ident: str, text: str, title: str, limit: str, out: str) -> str:
    """CTEs ending in ``{out}``: ident, keywords (list). ``source`` has the text and the title."""
    return f"""
{out}_counts AS MATERIALIZED (
  SELECT {ident}, token, any_value(tt) AS tt, any_value(lim) AS lim, count(*) AS n
  FROM (SELECT {ident}, list_distinct({tokens(title)}) AS tt, {limit} AS lim,
               unnest({tokens(text)}) AS token FROM {source})
  GROUP BY {ident}, token),
{out}_scored AS (
  SELECT {ident}, token, lim,
    n + CASE WHEN list_contains(tt, token) THEN 1.5 ELSE 0 END
      + CASE WHEN length(token) >= 2 THEN 0.5 ELSE 0 END
      - CASE WHEN n = 1 AND length(token) > 12 THEN 1 ELSE 0 END AS score
  FROM {out}_counts),
{out}_ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {ident} ORDER BY score DESC, token) AS rk
  FROM {out}_scored WHERE score > 0),
{out} AS MATERIALIZED (
  SELECT {ident}, list(token ORDER BY rk) AS keywords FROM {out}_ranked WHERE rk <= lim
  GROUP BY {ident})"""


AT = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id // 200 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z')"

BLOCKS = f"""
blocks AS MATERIALIZED (
  SELECT source AS session, doc_id AS ord,
    CASE WHEN length(text) < 900 THEN 'summary' ELSE 'raw' END AS layer,
    source || '-' || CAST(doc_id // 200 AS VARCHAR) AS compaction_id,
    {AT} AS "at",
    (doc_id // 200) * 200 AS seq_start, (doc_id // 200) * 200 + 199 AS seq_end, text
  FROM documents)"""

RECORDS = f"""{BLOCKS},
{title_ctes('blocks', 'ord', 'text', 'titles', "layer = 'summary'")},
titled AS MATERIALIZED (SELECT b.*, t.title FROM blocks b JOIN titles t USING (ord)),
{keyword_ctes('titled', 'ord', 'text', 'title', "CASE WHEN layer = 'summary' THEN 8 ELSE 10 END", 'kw')},
records AS MATERIALIZED (
  SELECT t.*, coalesce(k.keywords, []) AS keywords,
    substr(sha1(t.layer || chr(0) || t.text), 1, 16) AS fp
  FROM titled t LEFT JOIN kw k USING (ord))"""


def index_ctes(records: str = "records") -> str:
    """Index CTEs over a CTE of records."""
    return f"""
kept AS MATERIALIZED (
  SELECT * FROM {records} QUALIFY row_number() OVER (PARTITION BY session, fp ORDER BY ord) = 1),
entries AS (
  SELECT session, ord, layer, unnest({tokens('title')}) AS token, 3 AS w FROM kept
  UNION ALL
  SELECT session, ord, layer, unnest({tokens("array_to_string(keywords, ' ')")}) AS token, 4 AS w FROM kept
  UNION ALL
  SELECT session, ord, layer, unnest({tokens('text')}) AS token, 1 AS w FROM kept),
postings AS MATERIALIZED (
  SELECT session, ord, layer, token, CAST(sum(w) AS DOUBLE) AS tf FROM entries
  GROUP BY session, ord, layer, token),
lens AS (
  SELECT session, ord, sum(tf) AS len, count(*) AS terms FROM postings GROUP BY session, ord),
stats AS MATERIALIZED (
  SELECT k.session, k.ord, k.layer, k.fp, k."at", k.title, k.compaction_id, k.seq_end,
    coalesce(l.len, 0)::DOUBLE AS len, coalesce(l.terms, 0) AS terms,
    {conclusion('k.text')} AS concl
  FROM kept k LEFT JOIN lens l USING (session, ord)),
terms AS MATERIALIZED (SELECT session, token, count(*) AS df FROM postings GROUP BY session, token),
corpus AS MATERIALIZED (
  SELECT session, count(*) AS n, avg(len) AS avgdl FROM stats GROUP BY session)"""


INDEX = f"{RECORDS},{index_ctes()}"


def search_ctes(queries: str, *, by_layer: bool, limit: int, top: int = V.DENOMINATOR_TOP,
                in_session: bool = True, out: str = "hits") -> str:
    """CTEs ``{out}`` over ``queries`` (query_id, segment, text[, session])."""
    sess = ", session" if in_session else ""
    on = "USING (session, token)" if in_session else "USING (token)"
    part = "query_id, segment, session" + (", layer" if by_layer else "")
    cap = f"WHERE ir <= {top}" if top > 0 else ""
    return f"""
{out}_terms AS MATERIALIZED (
  SELECT query_id, segment{sess}, {floor_terms('text')} AS floor,
    len(list_distinct({tokens('text')})) AS n_terms,
    unnest(list_distinct({tokens('text')})) AS token
  FROM {queries}),
{out}_weighted AS MATERIALIZED (
  SELECT q.query_id, q.segment, t.session, q.floor, q.n_terms, token, c.avgdl,
    ln(1 + (c.n - t.df + 0.5) / (t.df + 0.5)) AS idf
  FROM {out}_terms q JOIN terms t {on} JOIN corpus c ON c.session = t.session),
{out}_den AS MATERIALIZED (
  SELECT query_id, segment, session, any_value(floor) AS floor, any_value(n_terms) AS n_terms,
    max(cnt) AS matchable, sum(idf) AS denominator
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id, segment, session) AS cnt,
          row_number() OVER (PARTITION BY query_id, segment, session ORDER BY idf DESC) AS ir
        FROM {out}_weighted)
  {cap} GROUP BY query_id, segment, session HAVING sum(idf) > 0),
{out}_raw AS (
  SELECT w.query_id, w.segment, w.session, p.ord, p.layer, count(*) AS matched,
    sum(w.idf * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.62 + 0.62 * s.len /
      CASE WHEN w.avgdl = 0 THEN 1 ELSE w.avgdl END))) AS raw
  FROM {out}_weighted w JOIN postings p USING (session, token) JOIN stats s USING (session, ord)
  GROUP BY w.query_id, w.segment, w.session, p.ord, p.layer),
{out}_scored AS (
  SELECT r.query_id, r.segment, r.session, r.ord, r.layer, r.matched, d.floor, d.n_terms,
    d.matchable, d.denominator, s.fp, s."at", s.title, s.concl, s.seq_end, s.compaction_id,
    round(r.raw / d.denominator * (1 + 0.06 * s.concl), 9) AS score
  FROM {out}_raw r JOIN {out}_den d USING (query_id, segment, session)
    JOIN stats s USING (session, ord)
  WHERE r.matched >= d.floor),
{out} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, "at" DESC, ord) AS rank
  FROM {out}_scored QUALIFY rank <= {limit})"""


QUESTIONS = "questions AS (SELECT item_id AS query_id, 0 AS segment, 'src' || (item_id % 20) AS session, text FROM benchmark)"


def sentences(x: str) -> str:
    e = V.SENTENCE_END
    piece = q(f"[^{e}\n]*[{e}]|[^{e}\n]+")
    whole = q(f"(?s)[^{e}]*[{e}]|[^{e}]+")
    strip = trim(f"replace(regexp_replace(x, {LEAD}, ''), '**', '')")
    pieces = (
        f"list_filter(list_transform(regexp_extract_all({x}, {piece}), lambda x: {strip}), "
        f"lambda x: x <> '')"
    )
    return (
        f"list_filter(list_transform(regexp_extract_all(array_to_string({pieces}, ' '), {whole}), "
        f"lambda x: {trim('x')}), lambda x: x <> '')"
    )


def time_shape(x: str) -> str:
    flag = {n: f"regexp_matches(lower({x}), {q(class_pattern(n))})" for n in V.TIME_WORDS}
    total = " + ".join(f"CAST({f} AS INTEGER)" for f in flag.values())
    arms = " ".join(f"WHEN {f} THEN {q(V.TIME_SHAPES[n])}" for n, f in flag.items())
    return f"CASE WHEN {total} <> 1 THEN NULL {arms} END"


def clip(x: str, limit: int) -> str:
    line = collapse(x)
    return (
        f"CASE WHEN length({line}) <= {limit} THEN {line} "
        f"ELSE substr({line}, 1, {limit}) || '…' END"
    )
