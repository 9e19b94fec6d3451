"""Oracle SQL of spelling variants and periodic runs; the checksum is built from its public polynomial."""

from __future__ import annotations

#: The 256 steps of the reflected CRC-32 (polynomial 0xEDB88320), one list.
_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"


def _crc_table() -> str:
    made = "SELECT i::BIGINT AS i, i::BIGINT AS c0 FROM range(256) t(i)"
    for k in range(8):
        made = f"SELECT i, {_STEP.format(c=f'c{k}')} AS c{k + 1} FROM ({made})"
    return f"crc AS MATERIALIZED (SELECT list(c8 ORDER BY i) AS t FROM ({made}))"


def _crc32(bytes_: str) -> str:
    """The unsigned checksum of a list of byte values; ``t`` is the table of steps."""
    folded = f"list_reduce(list_prepend(4294967295, {bytes_}), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))"
    return f"xor({folded}, 4294967295)"


def _bytes(x: str) -> str:
    return f"list_transform(range(1, strlen({x}) * 2, 2), lambda p: ('0x' || substr(hex(encode({x})), p, 2))::BIGINT)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""WITH RECURSIVE {_crc_table()},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS c, doc_id || ':' || run AS named FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, c, {_crc32(_bytes('named'))} AS h FROM each, crc),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
dels AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT d.word AS a, w.word AS b FROM dels d JOIN words w ON w.word = d.d
  UNION SELECT w.word, d.word FROM dels d JOIN words w ON w.word = d.d
  UNION SELECT x.word, y.word FROM dels x JOIN dels y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
near AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, max(n) AS top, min({{'less': -n, 'b': b}}) AS best
  FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best.b END AS form,
  CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at_, 0 AS depth FROM forms UNION ALL SELECT k.word, f.form, depth + 1 FROM walk k JOIN forms f ON f.word = k.at_ WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(at_, depth) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

PERIODIC = f"""WITH {_crc_table()},
docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_crc32(_bytes('doc_id::VARCHAR'))} AS h FROM documents, crc),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM docs),
places AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized),
looped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM places),
texts AS MATERIALIZED (SELECT doc_id, n, list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) AS ws FROM looped),
words AS MATERIALIZED (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM texts),
same AS (SELECT x.doc_id, y.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS MATERIALIZED (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, q AS period FROM stretches s WHERE length >= greatest(6, 4 * q)
  AND NOT EXISTS (SELECT 1 FROM stretches z WHERE z.doc_id = s.doc_id AND z.q < s.q AND s.q % z.q = 0 AND z.start <= s.start AND z.start + z.length >= s.start + s.length)),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  min({{'l': -length, 's': start, 'p': period}}) AS best FROM runs GROUP BY doc_id),
dropped AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = w.doc_id AND d.i = w.i) GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, 1000 * -best.l // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN told USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
