"""Why a question missed: coverage, verdict, token spread, candidate pages and page picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import tokens as K
from palimpsest.functions.parsing import page_intent, page_pick
from palimpsest.functions.titles import snippet, time_label
from palimpsest.operators.index import BlockIndex
from palimpsest.operators.ordered import top_per_key
from palimpsest.operators.search import search
from palimpsest.operators.similar import substring_counts

ASK = ["query_id", "session"]
STRONG_RATIO = 1.5
SHOWN_TERMS = 20


def coverage(index: BlockIndex, questions: DataFrame) -> DataFrame:
    """Known and unknown tokens per question, each asked in its own session. ``absent`` is the whole list, in
    the question's order; ``shown_terms`` cuts it for display."""
    tokens = questions.select(*ASK, F.posexplode(K.token_set(F.col("text")))).select(
        *ASK, F.col("pos"), F.col("col").alias("token")
    )
    known = tokens.join(
        index.terms_of(tokens).select("session", "token", F.lit(True).alias("_known")),
        ["session", "token"], "left",
    )
    missing = F.array_sort(
        F.collect_list(F.when(F.col("_known").isNull(), F.struct("pos", "token")))
    )
    counted = known.groupBy(*ASK).agg(
        F.count("*").alias("total"), F.count("_known").alias("present"),
        F.transform(missing, lambda m: m["token"]).alias("absent"),
    )
    return questions.select(*ASK).join(counted, ASK, "left").select(
        *ASK, F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("present", F.lit(0)).alias("present"),
        F.coalesce("absent", F.array().cast("array<string>")).alias("absent"),
    )


def shown_terms(absent: Column, limit: int = SHOWN_TERMS) -> Column:
    """The absent words that a report shows."""
    return F.slice(absent, 1, limit)


def verdicts(
    index: BlockIndex, questions: DataFrame, *, min_score: float = 0.28,
    dropped: DataFrame | None = None,
) -> DataFrame:
    """absent, not-ingested, scattered or above-threshold for each question.

    ``dropped``: session, text — compacted originals that may hold words the store lacks.
    """
    best = search(index, questions, limit=1).select(
        *ASK, K.round_half_up(F.col("score"), 4).alias("_best")
    )
    out = coverage(index, questions).join(best, ASK, "left").withColumn(
        "best", F.coalesce("_best", F.lit(0.0))
    ).drop("_best")
    if dropped is not None:
        lost = dropped.select("session", F.explode(K.token_set(F.col("text"))).alias("token")).distinct()
        hit = (
            out.where("present = 0").select(*ASK, F.explode("absent").alias("token"))
            .join(lost, ["session", "token"], "left_semi").select(*ASK).distinct()
            .withColumn("_lost", F.lit(True))
        )
        out = out.join(hit, ASK, "left")
    else:
        out = out.withColumn("_lost", F.lit(None).cast("boolean"))
    verdict = (
        F.when((F.col("present") == 0) & F.col("_lost").isNotNull(), "not-ingested")
        .when(F.col("present") == 0, "absent")
        .when(F.col("best") < min_score, "scattered")
        .otherwise("above-threshold")
    )
    return out.withColumn("verdict", verdict).drop("_lost")


def strong_hit(score, min_score: float = 0.28):
    """Whether a local hit is good enough to skip the rewrite."""
    return score >= max(0.0, min_score, STRONG_RATIO * min_score)


def token_spread(records: DataFrame, questions: DataFrame, top: int = 12) -> DataFrame:
    """Per question, the tokens found as substrings in the most records of its session.

    The test is case-sensitive on the stored title, keywords and text.
    """
    asked = questions.select(*ASK, F.posexplode(K.token_set(F.col("text")))).select(
        *ASK, "pos", F.col("col").alias("token")
    ).where(F.length("token") > 1)
    haystack = F.concat_ws("\n", "title", F.array_join("keywords", " "), "text")
    found = substring_counts(records.select("session", "ord", haystack.alias("hay")), asked)
    counted = asked.join(found, ["session", "token"], "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return top_per_key(counted, ASK, [F.desc("records"), F.asc("pos")], top, "place")


def candidate_pool(hits: DataFrame) -> DataFrame:
    """Conversation blocks with text among a question's top hits, numbered again from 1."""
    usable = hits.where("coalesce(src, '') <> 'tool' and not blank")
    w = Window.partitionBy(*ASK).orderBy("rank")
    return usable.withColumn("place", F.row_number().over(w))


def fallback_candidates(hits: DataFrame, top: int = 3) -> DataFrame:
    """What is offered when no page was picked: the first conversation blocks with different texts."""
    first = Window.partitionBy(*ASK, "fp").orderBy("rank")
    distinct = candidate_pool(hits).withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy", "place")
    return top_per_key(distinct, ASK, [F.asc("rank")], top, "place")


def merged_candidates(hits: DataFrame, more: DataFrame, limit: int = 12) -> DataFrame:
    """A question's hits and those of its rewrite that have other fingerprints, sorted again."""
    cols = [*ASK, "ord", "layer", "fp", "at", "score"]
    fresh = more.select(*cols).join(hits.select(*ASK, "fp").distinct(), [*ASK, "fp"], "left_anti")
    both = hits.select(*cols, F.lit(False).alias("rewritten")).unionByName(
        fresh.select(*cols, F.lit(True).alias("rewritten"))
    )
    order = [F.desc("score"), F.desc(F.coalesce("at", F.lit(""))), F.asc("ord")]
    return top_per_key(both, ASK, order, limit, "place")


def pages(
    pool: DataFrame, *, page_size: int = 30, max_chars: int = 4000, snippet_chars: int = 60
) -> DataFrame:
    """Candidates laid out in pages; items past a page's character cap are marked skipped.

    ``pool``: query_id, session, place, title, text, at — a bounded list per question. The next
    page always starts ``page_size`` further on, so skipped items are not carried over.
    """
    page = F.floor((F.col("place") - 1) / page_size)
    w = Window.partitionBy(*ASK, "page").orderBy("place")
    laid = (
        pool.withColumn("page", page)
        .withColumn("title", snippet(F.col("title"), 40))
        .withColumn("snippet", snippet(K.trim_ws(F.col("text")), snippet_chars))
        .withColumn("time", time_label(F.col("at")))
        .withColumn("cost", F.length("title") + F.length("snippet") + F.length("time") + 12)
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_sum", F.sum("cost").over(w))
    )
    shown = (F.col("_n") == 1) | (F.col("_sum") <= max_chars)
    time = F.when(F.col("time") == "", "").otherwise(F.concat(F.lit(" "), "time", F.lit(" ·")))
    return laid.withColumn("shown", shown).withColumn(
        "line",
        F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("]"), time, F.lit(" "), "title",
                 F.lit("："), "snippet"),
    ).withColumnRenamed("_n", "number").drop("_sum")


def pick_across_pages(answers: DataFrame, page_limit: int = 4) -> DataFrame:
    """First decisive page per question: a found block, or an error that stops the search.

    ``answers``: query_id, session, page (from 0), items, ok, answer — one row per judged page.
    """
    seen = answers.where((F.col("page") < page_limit) & (F.col("items") > 0)).withColumn(
        "_pick", page_pick(F.col("answer"), F.col("items"))
    )
    stops = ~F.col("ok") | (F.col("_pick.kind") == "found")
    first = seen.groupBy(*ASK).agg(
        F.min(F.when(stops, F.struct("page", "ok", F.col("_pick.index").alias("index")))).alias("_end"),
        F.min_by(page_intent(F.col("answer")), "page").alias("intent"),
        F.count("*").alias("_pages"), F.collect_list("page").alias("_list"),
    )
    until = F.coalesce("_end.page", F.lit(2**31 - 1))
    found = F.coalesce(F.col("_end.ok"), F.lit(False))
    return first.select(
        *ASK, found.alias("found"),
        F.when(found, F.col("_end.index")).otherwise(0).alias("index"),
        (F.coalesce("_end.page", F.col("_pages") - 1) + 1).cast("bigint").alias("page"),
        F.size(F.filter("_list", lambda p: p <= until)).cast("bigint").alias("asked"), "intent",
    )


def history(blocks: DataFrame, limit: int = 5, max_chars: int = 12_000) -> DataFrame:
    """Chosen old blocks per key in order, clipped so that a key's total stays in budget.

    ``blocks``: key, place, text with place numbering the chosen blocks from 1.
    """
    w = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return blocks.where(F.col("place") <= limit).withColumn("_before", before).where(
        F.col("_before") < max_chars
    ).withColumn(
        "text", F.col("text").substr(F.lit(1), (F.lit(max_chars) - F.col("_before")).cast("int"))
    ).drop("_before")


def similar_turns(turns: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """Turns of a session ranked by token overlap with the session's question."""
    wanted = questions.select("session", K.token_set(F.col("text")).alias("_wanted"))
    own = K.token_set(F.concat_ws("\n", "user", "assistant"))
    scored = (
        turns.join(wanted, "session")
        .withColumn("score", F.round(K.jaccard(F.col("_wanted"), own), 9))
        .where("score > 0")
    )
    return top_per_key(scored, ["session"], [F.desc("score"), F.asc("turn_no")], limit, "place")
