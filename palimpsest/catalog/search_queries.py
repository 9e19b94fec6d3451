"""Index tables, scoring and ranking over documents as blocks and benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Registry
from palimpsest.catalog import sqlparts as S
from palimpsest.operators.index import BlockIndex, build_index
from palimpsest.operators.search import denominators, idf, query_terms, search, weighted_terms
from palimpsest.session import release, settle
from palimpsest.sources.tables import document_records, questions

registry = Registry()


_RECORDS: dict[tuple[str, str], DataFrame] = {}
_INDEXES: dict[tuple[str, str], BlockIndex] = {}


def stored_records(spark, sf_dir):
    """The written record table of one data folder, made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RECORDS:
        _RECORDS[key] = settle(document_records(spark, sf_dir))
        release(spark)
    return _RECORDS[key]


def _index(spark, sf_dir):
    """The written index of one data folder, built once per application and then reread."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(stored_records(spark, sf_dir)).settled()
    return _INDEXES[key]


@registry.add(
    "block_records",
    f"""WITH {S.RECORDS}
SELECT session, ord, layer, compaction_id, "at", seq_start, seq_end, title,
  array_to_string(keywords, ' ') AS keywords, length(text) AS chars, fp FROM records""",
)
def block_records(spark, sf_dir):
    return document_records(spark, sf_dir).select(
        "session", "ord", "layer", "compaction_id", "at", "seq_start", "seq_end", "title",
        F.array_join("keywords", " ").alias("keywords"),
        F.length("text").cast("bigint").alias("chars"), "fp",
    )


@registry.add(
    "block_lengths",
    f"""WITH {S.INDEX}
SELECT session, ord, layer, len, CAST(terms AS BIGINT) AS terms, concl FROM stats""",
)
def block_lengths(spark, sf_dir):
    blocks = build_index(stored_records(spark, sf_dir)).blocks
    return blocks.select(
        "session", "ord", "layer", "len", F.col("terms").cast("bigint").alias("terms"), "concl"
    )


@registry.add(
    "weighted_tf",
    f"WITH {S.INDEX} SELECT session, ord, layer, token, tf FROM postings",
)
def weighted_tf(spark, sf_dir):
    postings = build_index(stored_records(spark, sf_dir)).postings
    return postings.select("session", "ord", "layer", "token", "tf")


@registry.add(
    "token_df",
    f"WITH {S.INDEX} SELECT session, token, df FROM terms",
)
def token_df(spark, sf_dir):
    return build_index(stored_records(spark, sf_dir)).terms


@registry.add(
    "idf_table",
    f"""WITH {S.INDEX}
SELECT t.session, t.token, t.df, c.n, round(ln(1 + (c.n - t.df + 0.5) / (t.df + 0.5)), 6) AS idf,
  round(c.avgdl, 6) AS avgdl FROM terms t JOIN corpus c USING (session)""",
)
def idf_table(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.terms.join(index.corpus, "session").select(
        "session", "token", "df", "n", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"),
        F.round("avgdl", 6).alias("avgdl"),
    )


_ASK = f"WITH {S.INDEX}, {S.QUESTIONS}, "


@registry.add(
    "capped_denominator",
    _ASK + S.search_ctes("questions", by_layer=False, limit=1) + """
SELECT query_id, session, CAST(floor AS BIGINT) AS floor, CAST(n_terms AS BIGINT) AS n_terms,
  matchable, round(denominator, 6) AS denominator FROM hits_den""",
)
def capped_denominator(spark, sf_dir):
    weighted = weighted_terms(_index(spark, sf_dir), query_terms(questions(spark, sf_dir)))
    return denominators(weighted).select(
        "query_id", "session", F.col("floor").cast("bigint").alias("floor"),
        F.col("n_terms").cast("bigint").alias("n_terms"), "matchable",
        F.round("denominator", 6).alias("denominator"),
    )


@registry.add(
    "bm25_topk",
    _ASK + S.search_ctes("questions", by_layer=False, limit=8) + """
SELECT query_id, session, ord, layer, fp, title, rank, matched, matchable,
  CAST(n_terms AS BIGINT) AS n_terms, round(score, 6) AS score FROM hits""",
)
def bm25_topk(spark, sf_dir):
    hits = search(_index(spark, sf_dir), questions(spark, sf_dir), limit=8)
    return hits.select(
        "query_id", "session", "ord", "layer", "fp", "title",
        F.col("rank").cast("bigint").alias("rank"), "matched", "matchable",
        F.col("n_terms").cast("bigint").alias("n_terms"), F.round("score", 6).alias("score"),
    )
