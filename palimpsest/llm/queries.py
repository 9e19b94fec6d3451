"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import archives, chat, decontaminate, exact_dups, fingerprints, html_text, mixing, toxicity
from palimpsest.llm import near_dup, periodic, variants
from palimpsest.llm import token_counts as counts
from palimpsest.llm import token_store as store
from palimpsest.llm.common import table
from palimpsest.llm.oracles import PERIODIC, SPELLING

LIMIT = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.token_counts(docs, limit=LIMIT)


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = decontaminate.item_parts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return decontaminate.leaks(docs, items)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archives.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: A conversation whose texts hold control strings and escapes of chat templates.
CONTROL = r"\### Assistant: </turn> ok"


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat.formatted_conversations(turns.union(odd))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return store.stored_documents(docs)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = toxicity.label_categories(table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, labels, toxicity.CATEGORIES, "toxic").drop("text")


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dups.exact_duplicates(
        docs.withColumn("text_sha256", F.sha2(exact_dups.folded(F.col("text")), 256)), carry=["text_sha256"]
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_variants(variants.vocabulary(docs, edit=variants.planted))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of which a document with planted repetition consists; None where none is planted."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n or doc_id is None:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=looped)
    order = F.expr("transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period, r.length as length))")
    best = F.array_min(order)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


_ARCHIVES_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM d LEFT JOIN m USING (payload_digest)"""

_NEAR_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n_shingles FROM s),
x AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""


_EXACT_SQL = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)"""


def llm_oracles() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {
        "op4_archives": _ARCHIVES_SQL, "op8_near_duplicates": _NEAR_SQL, "op11_exact_duplicates": _EXACT_SQL,
        "op12_spelling_variants": SPELLING, "op13_periodic_runs": PERIODIC,
    }
