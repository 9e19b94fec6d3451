"""Oracle SQL of the chunker: paragraphs, size-bounded cuts, packing and the merge of tiny blocks."""

from __future__ import annotations

from palimpsest import vocab as V
from palimpsest.catalog import sqlparts as S

_W = "[" + V.WS.replace("\n", "") + "]"
HEADING = f"{_W}{{0,3}}#{{1,6}}{_W}+[^{V.WS}]"
#: A line end before a heading becomes two, so that splitting at blank lines splits there as well.
_OPENED = S.q(f"\n({HEADING})")


def split_at_headings(x: str, mark: str) -> str:
    """``x`` split before each heading line; ``mark`` occurs nowhere in it."""
    return f"string_split(regexp_replace({x}, {_OPENED}, {mark} || '\\1', 'g'), {mark})"


def paragraphs(x: str) -> str:
    blank = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN {S.trim('l')} = '' THEN '' ELSE l END), chr(10))"
    opened = f"regexp_replace({blank}, {_OPENED}, chr(10) || chr(10) || '\\1', 'g')"
    return f"list_filter(list_transform(string_split_regex({opened}, '\\n{{2,}}'), lambda p: {S.trim('p')}), lambda p: p <> '')"


def slice_ctes(source: str, keys: str, text: str, limit: int, out: str) -> str:
    """CTE ``out`` (recursive): keys, part, piece, last: ``text`` cut after the last boundary past half way."""
    head = f"substr(rest, 1, {limit})"
    place = f"length(regexp_extract({head}, '(?s)^(.*)[\\n。； ]', 0))"
    size = (
        f"CASE WHEN length(rest) <= {limit} THEN length(rest) WHEN {place} > {limit // 2} THEN {place} ELSE {limit} END"
    )
    return f"""
{out}_w AS (
  SELECT {keys}, 0 AS part, {text} AS rest, NULL::VARCHAR AS piece FROM {source}
  UNION ALL
  SELECT {keys}, part + 1, substr(rest, n + 1), substr(rest, 1, n) FROM (SELECT *, {size} AS n FROM {out}_w WHERE rest <> '')),
{out} AS MATERIALIZED (SELECT {keys}, part, piece, rest = '' AS last FROM {out}_w WHERE part > 0)"""


def block_ctes(source: str, keys: str, text: str, target: int, limit: int, out: str) -> str:
    """CTE ``out``: keys and ``blocks``, the list of packed blocks of each text of ``source``."""
    on = " AND ".join(f"w.{k.strip()} = i.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    closed = "CASE WHEN w.cur = '' THEN w.blocks ELSE list_append(w.blocks, w.cur) END"
    fits = f"length(w.cur) + length(i.x) + 1 <= {target}"
    return f"""
{out}_p AS MATERIALIZED (SELECT {keys}, unnest(ps) AS run, unnest(range(len(ps))) AS r FROM (SELECT {keys}, {paragraphs(text)} AS ps FROM {source})),
{slice_ctes(f'{out}_p', keys + ', r', 'run', limit, f'{out}_s')},
{out}_i AS MATERIALIZED (SELECT {keys}, {S.trim('piece')} AS x, last, row_number() OVER (PARTITION BY {keys} ORDER BY r, part) AS n FROM {out}_s),
{out}_k AS (
  SELECT {keys}, 0::BIGINT AS n, ''::VARCHAR AS cur, []::VARCHAR[] AS blocks FROM {source}
  UNION ALL
  SELECT {own}, i.n,
    CASE WHEN NOT i.last THEN '' WHEN i.x = '' THEN w.cur WHEN w.cur = '' THEN i.x WHEN {fits} THEN w.cur || chr(10) || i.x ELSE i.x END,
    CASE WHEN NOT i.last THEN list_append({closed}, i.x) WHEN i.x = '' OR w.cur = '' OR {fits} THEN w.blocks ELSE list_append(w.blocks, w.cur) END
  FROM {out}_k w JOIN {out}_i i ON {on} AND i.n = w.n + 1),
{out} AS MATERIALIZED (SELECT {keys}, CASE WHEN cur = '' THEN blocks ELSE list_append(blocks, cur) END AS blocks
  FROM {out}_k QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1)"""


def merge_ctes(source: str, key: str, limit: int, out: str) -> str:
    """CTE ``out``: key, blocks from ``source`` (key, n from 1, x) with tiny blocks merged."""
    tiny = V.TINY_BLOCK_CHARS
    piece = "CASE WHEN w.cur = '' THEN i.x ELSE w.cur || chr(10) || i.x END"
    fits = f"len(blocks) > 0 AND length(blocks[-1]) + length(p) + 1 <= {limit + tiny}"
    joined = "list_append(blocks[1 : len(blocks) - 1], blocks[-1] || chr(10) || {p})"
    return f"""
{out}_k AS (
  SELECT DISTINCT {key}, 0::BIGINT AS n, ''::VARCHAR AS cur, []::VARCHAR[] AS blocks FROM {source}
  UNION ALL
  SELECT {key}, n, CASE WHEN length(p) < {tiny} AND NOT ({fits}) THEN p ELSE '' END,
    CASE WHEN length(p) >= {tiny} THEN list_append(blocks, p) WHEN {fits} THEN {joined.format(p='p')} ELSE blocks END
  FROM (SELECT i.{key}, i.n, w.blocks, {piece} AS p FROM {out}_k w JOIN {source} i ON i.{key} = w.{key} AND i.n = w.n + 1)),
{out}_e AS (SELECT {key}, cur AS p, blocks FROM {out}_k QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC) = 1),
{out} AS MATERIALIZED (SELECT {key}, list_filter(CASE WHEN p = '' THEN blocks WHEN {fits} THEN {joined.format(p='p')} ELSE list_append(blocks, p) END,
  lambda x: {S.trim('x')} <> '') AS blocks FROM {out}_e)"""


_HEADED = r"headed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\. ([A-F])', '.' || chr(10) || chr(10) || '## \1', 'g') AS text FROM documents)"
_LISTED = "SELECT doc_id, CAST(unnest(range(len(blocks))) AS INTEGER) AS pos, unnest(blocks) AS block FROM"

SPLIT_BLOCKS = f"WITH RECURSIVE {_HEADED},{block_ctes('headed', 'doc_id', 'text', 420, 900, 'b')} {_LISTED} b"

_HEAD_MARK = S.q(f"^{_W}{{0,3}}#{{1,6}}{_W}+")
_FIRST = "split_part(run, chr(10), 1)"
_IS_HEAD = f"regexp_matches({_FIRST}, {S.q('^' + HEADING)})"

SUMMARY_SECTIONS = f"""WITH RECURSIVE {_HEADED},
runs AS (SELECT doc_id, unnest(rs) AS run, unnest(range(len(rs))) AS s FROM (SELECT doc_id, {split_at_headings('text', 'chr(1)')} AS rs FROM headed)),
sections AS MATERIALIZED (SELECT doc_id, s,
  CASE WHEN {_IS_HEAD} THEN '## ' || {S.trim(f"regexp_replace({_FIRST}, {_HEAD_MARK}, '')")} ELSE '' END AS h,
  {S.trim(f"CASE WHEN {_IS_HEAD} THEN substr(run, length({_FIRST}) + 1) ELSE run END")} AS body FROM runs),
{block_ctes('sections', 'doc_id, s', 'body', 500, 900, 'b')},
named AS (SELECT doc_id, s, unnest(range(len(blocks))) AS p, CASE WHEN h = '' THEN '' ELSE h || chr(10) END || unnest(blocks) AS t
  FROM sections JOIN b USING (doc_id, s) WHERE body <> ''),
{slice_ctes('named', 'doc_id, s, p', 't', 900, 'c')},
pieces AS (SELECT doc_id, s, p, part, piece FROM c WHERE part = 1 OR {S.trim('piece')} <> ''
  UNION ALL SELECT doc_id, s, 0, 0, h FROM sections WHERE body = '' AND h <> ''),
seq AS MATERIALIZED (SELECT doc_id, piece AS x, row_number() OVER (PARTITION BY doc_id ORDER BY s, p, part) AS n FROM pieces),
{merge_ctes('seq', 'doc_id', 900, 'm')} {_LISTED} m"""
