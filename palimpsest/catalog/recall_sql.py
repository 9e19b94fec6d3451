"""Oracle SQL of recall lines, duplicate gates and recall blocks, stage by stage as common table expressions."""

from __future__ import annotations

from palimpsest import vocab as V
from palimpsest.catalog import sqlparts as S


def collapse_repeats(x: str) -> str:
    arms = " ".join(
        f"WHEN length({x}) % {k} = 0 AND length({x}) // {k} >= 8 AND "
        f"repeat(substr({x}, 1, length({x}) // {k}), {k}) = {x} THEN substr({x}, 1, length({x}) // {k})"
        for k in range(2, 13)
    )
    return f"CASE WHEN length({x}) < 24 THEN {x} {arms} ELSE {x} END"


def sampled(x: str, limit: str) -> str:
    """At most ``limit`` characters of ``x``: three quarters head, an ellipsis, the tail."""
    m = f"greatest(0, {limit})"
    head = f"greatest(1, least({m} - 2, CAST(floor(({m} - 1) * 0.75::DOUBLE) AS INTEGER)))"
    tail = f"greatest(1, {m} - 1 - {head})"
    return (
        f"CASE WHEN length({x}) <= {m} THEN {x} WHEN {m} <= 2 THEN substr('…', 1, {m}) "
        f"WHEN length({x}) - {tail} <= {head} THEN substr({x}, 1, {m} - 1) "
        f"ELSE substr({x}, 1, {head}) || '…' || right({x}, {tail}) END"
    )


def without_lead(ss: str, lead: str) -> str:
    """Sentences that the lead does not hold and that do not hold its first 40 characters."""
    head = S.trim(lead)
    return (
        f"CASE WHEN length({head}) < 6 THEN {ss} ELSE list_filter({ss}, lambda x: NOT (contains({head}, x) "
        f"OR (length({head}) >= 40 AND contains(x, substr({head}, 1, 40))))) END"
    )


def fitting(ss: str, limit: str) -> str:
    """How many leading elements fit into ``limit`` characters when joined by one space."""
    upto = f"list_sum(list_transform({ss}[1:x], lambda y: length(y))) + x - 1"
    return f"len(list_filter(range(1, least(len({ss}), 400) + 1), lambda x: {upto} <= {limit}))"


def _step(n: int, part: str) -> str:
    """Stage ``n`` of packing: ``part`` is added to the line while it fits, cut once, then nothing more."""
    room = f"(budget - used{n - 1} - 3)"
    skip = f"full{n - 1} OR {part} = ''"
    fits = f"length({part}) <= {room}"
    return f"""
    CASE WHEN {skip} THEN text{n - 1} WHEN {fits} THEN text{n - 1} || ' — ' || {part}
      WHEN {room} >= 6 THEN text{n - 1} || ' — ' || substr({part}, 1, {room} - 1) || '…' ELSE text{n - 1} END AS text{n},
    CASE WHEN {skip} THEN used{n - 1} WHEN {fits} THEN used{n - 1} + 3 + length({part}) ELSE budget END AS used{n},
    CASE WHEN {skip} THEN full{n - 1} ELSE NOT ({fits}) END AS full{n}"""


def line_ctes(source: str, out: str, limit: int = 300) -> str:
    """CTE ``out``: the rows of ``source`` (title, text, …) with ``line``, what a recall shows of the block."""
    kind = (
        "CASE WHEN regexp_matches(x, '(?s)^问：.*?答：') THEN 'A' WHEN starts_with(x, '问：') THEN 'q' "
        "WHEN starts_with(x, '答：') THEN 'a' ELSE 'n' END"
    )
    pipes = "length(x) - length(replace(x, '|', ''))"
    conclusive = " OR ".join(f"contains(x, {S.q(m)})" for m in V.CONCLUSION_MARKERS)
    folded = lambda s, x: (
        f"CASE WHEN len({s}) < 2 THEN {x} ELSE "
        + collapse_repeats(f"array_to_string(list_filter({s}, lambda y, i: i = 1 OR y <> {s}[i - 1]), ' ')") + " END"
    )
    covers = (
        "length(d) >= 6 AND (d = x OR starts_with(d, x) OR starts_with(x, d) OR starts_with(x, substr(d, 1, 40)) "
        "OR (length(d) >= 60 AND contains(x, d)))"
    )
    p = f"{out}_"
    return f"""
{p}0 AS (SELECT *, {S.trim("coalesce(title, '')")} AS rt, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS raw FROM {source}),
{p}1 AS (SELECT *, list_filter(list_transform(string_split(raw, chr(10)), lambda x: {S.clean_line('x')}), lambda x: x <> '' AND x <> rt) AS ls FROM {p}0),
{p}2 AS (SELECT *, list_transform(ls, lambda x: {kind}) AS kinds FROM {p}1),
{p}3 AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: kinds[i] <> 'n') AS heads FROM {p}2),
{p}4 AS (SELECT *,
  list_filter(list_transform(list_filter(heads, lambda h: kinds[h] IN ('a', 'A')), lambda h:
    {S.trim("CASE WHEN kinds[h] = 'A' THEN regexp_extract(ls[h], '(?s)^问：.*?答：(.*)$', 1) ELSE substr(ls[h], 3) END")}
    || coalesce(array_to_string(list_transform(ls[h + 1 : coalesce(list_filter(heads, lambda j: j > h)[1], len(ls) + 1) - 1], lambda y: chr(10) || y), ''), '')),
    lambda x: x <> '') AS answers,
  list_transform(list_filter(range(1, len(ls) + 1), lambda i: kinds[i] = 'n' AND (len(heads) = 0 OR i < heads[1]
    OR kinds[list_filter(heads, lambda j: j < i)[-1]] = 'q')), lambda i: ls[i]) AS body0 FROM {p}3),
{p}5 AS (SELECT *, len(answers) > 0 AS answered, array_to_string(answers, ' ') AS said,
  CASE WHEN len(body0) = 0 AND len(answers) = 0 THEN ls ELSE body0 END AS body,
  {limit} - CASE WHEN rt = '' THEN 0 ELSE length(rt) + 3 END AS budget FROM {p}4),
{p}6 AS (SELECT *, CASE WHEN answered THEN said ELSE coalesce(body[1], '') END AS lead0,
  {S.collapse("CASE WHEN len(body) > 0 THEN array_to_string(body, ' ') ELSE said END")} AS sample0 FROM {p}5),
{p}7 AS (SELECT *, {S.sentences('lead0')} AS lead_s, {S.sentences('sample0')} AS sample_s FROM {p}6),
{p}8 AS (SELECT *, {folded('lead_s', 'lead0')} AS lead, {folded('sample_s', 'sample0')} AS sample,
  greatest(6, CAST(ceil(budget * CASE WHEN answered THEN 0.8::DOUBLE ELSE 0.75::DOUBLE END) AS INTEGER)) AS cap FROM {p}7),
{p}9 AS (SELECT *, CASE WHEN budget > cap * 1.5::DOUBLE THEN cap ELSE budget END AS room FROM {p}8),
{p}10 AS (SELECT *, CASE WHEN lead = '' THEN '' ELSE {sampled('lead', 'room')} END AS part, {S.sentences('lead')} AS emitted,
  {S.sentences('CASE WHEN answered THEN said ELSE raw END')} AS source_s,
  {S.sentences('CASE WHEN answered THEN said ELSE sample END')} AS pool FROM {p}9),
{p}11 AS (SELECT *, list_filter(source_s, lambda x: length(x) BETWEEN 6 AND 160 AND NOT ({pipes} >= 3 OR contains(x, '---'))
  AND ({conclusive}) AND NOT list_contains(emitted, x)) AS found FROM {p}10),
{p}12 AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i)[1:2] AS two FROM {p}11),
{p}13 AS (SELECT *, {without_lead('two', 'part')} AS concl FROM {p}12),
{p}14 AS (SELECT *, list_concat(emitted, concl) AS told FROM {p}13),
{p}15 AS (SELECT *, CASE WHEN len(list_filter(pool, lambda x: NOT list_contains(told, x))) = 0 THEN []
  ELSE list_filter(pool, lambda x: len(list_filter(told, lambda d: {covers})) = 0) END AS rest0 FROM {p}14),
{p}16 AS (SELECT *, {without_lead('rest0', 'part')} AS rest,
  greatest(6, CAST(ceil(budget * 0.25::DOUBLE) AS INTEGER), budget - length(part) - 3) AS m FROM {p}15),
{p}17 AS (SELECT *, array_to_string(rest, ' ') AS whole, {fitting('rest', 'greatest(1, CAST(floor((m - 1) * 0.75::DOUBLE) AS INTEGER))')} AS h FROM {p}16),
{p}18 AS (SELECT *, list_reverse(rest[h + 1 :]) AS back, CASE WHEN h = 0 THEN 0 ELSE length(array_to_string(rest[1:h], ' ')) END AS hused FROM {p}17),
{p}19 AS (SELECT *, {fitting('back', 'm - hused - 1')} AS t FROM {p}18),
{p}20 AS (SELECT *, CASE WHEN len(rest) = 0 THEN '' WHEN length(whole) <= m THEN whole WHEN m <= 2 THEN substr('…', 1, m)
  WHEN h = 0 AND t = 0 THEN {sampled('whole', 'm')}
  ELSE coalesce(array_to_string(rest[1:h], ' '), '') || '…' || coalesce(array_to_string(list_reverse(back[1:t]), ' '), '') END AS tail FROM {p}19),
{p}21 AS (SELECT *, CASE WHEN tail = '' AND len(concl) = 0 AND length(lead) > length(part) THEN {sampled('lead', 'budget')} ELSE part END AS text0,
  coalesce(concl[1], '') AS c1, coalesce(concl[2], '') AS c2 FROM {p}20),
{p}22 AS (SELECT *, length(text0) AS used0, FALSE AS full0 FROM {p}21),
{p}23 AS (SELECT *, {_step(1, 'c1')} FROM {p}22),
{p}24 AS (SELECT *, {_step(2, 'c2')} FROM {p}23),
{p}25 AS (SELECT *, {_step(3, 'tail')} FROM {p}24),
{p}26 AS (SELECT *, CASE WHEN lead <> '' THEN lead ELSE sample END AS other FROM {p}25),
{p}27 AS (SELECT *, CASE WHEN text0 <> '' AND text3 <> '' THEN text3 ELSE {S.trim(sampled('other', 'budget'))} END AS shown FROM {p}26),
{p}28 AS (SELECT *, {S.collapse("concat_ws(' — ', nullif(rt, ''), nullif(shown, ''))")} AS joined FROM {p}27),
{out} AS MATERIALIZED (SELECT * EXCLUDE (rt, raw, ls, kinds, heads, answers, body0, answered, said, body, lead0, sample0, lead_s, sample_s, lead,
    sample, cap, room, part, emitted, source_s, pool, found, two, concl, told, rest0, rest, m, whole, h, back, hused, t, tail, text0, c1, c2,
    used0, full0, text1, used1, full1, text2, used2, full2, text3, used3, full3, other, shown, joined, budget),
  CASE WHEN budget <= 0 AND rt <> '' THEN substr(rt, 1, {limit - 1}) || '…'
    WHEN budget <= 6 AND rt <> '' THEN rt || ' — ' || {sampled('lead', 'budget')}
    WHEN length(joined) <= {limit} THEN joined ELSE substr(joined, 1, {limit - 1}) || '…' END AS line FROM {p}28)"""
