"""The recap of a session: ranked block titles with a conclusion, packed into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.functions.titles import clean_line, is_fragment_title
from palimpsest.operators.ordered import exact_rank

MAX_LINES = 12


def _header_tokens() -> int:
    ink = "".join(c for c in V.RECAP_HEADER if c not in V.WS)
    ranges = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF)]
    cjk = sum(any(a <= ord(c) <= b for a, b in ranges) for c in ink)
    return -int(-(cjk * 0.85 + (len(ink) - cjk) / 4) // 1)


def conclusion_line(title: Column, text: Column) -> Column:
    """First informative line of a block that does not repeat its title, at most 64 characters."""
    lines = F.transform(F.split(text, "\n"), clean_line)
    repeats = lambda x: (F.length(title) >= 6) & (
        F.startswith(x, title) | F.startswith(title, x)
    )
    useful = F.filter(
        lines,
        lambda x: (x != title) & ~F.startswith(x, F.lit("问：")) & (F.length(x) >= 8) & ~repeats(x),
    )
    return K.let(
        F.coalesce(F.get(useful, F.lit(0)), F.lit("")),
        lambda x: F.when(F.length(x) <= 64, x).otherwise(
            F.concat(F.substring(x, 1, 64), F.lit("…"))
        ),
    )


def recap_candidates(records: DataFrame) -> DataFrame:
    """Eligible blocks with their recap score. Summaries only, where a session has any."""
    has_summary = records.groupBy("session").agg(
        F.bool_or(F.col("layer") == "summary").alias("_any")
    )
    pool = records.join(has_summary, "session").where("not _any or layer = 'summary'")
    key = F.coalesce("compaction_id", "at", F.lit("unknown"))
    pool = pool.withColumn("_group", key).withColumn("at", F.coalesce("at", F.lit("")))
    groups = pool.groupBy("session", "_group").agg(F.max("at").alias("_at"), F.min("ord").alias("_o"))
    # Newest group first is the reverse of oldest first, so the age is the rank from the old end.
    oldest_first = exact_rank(
        groups, ["session"], [F.col("_at"), -F.col("_o")], "_age"
    )
    counts = groups.groupBy("session").agg(F.count("*").alias("_groups"))
    recency = F.when(F.col("_groups") <= 1, 0.0).otherwise(
        0.15 * (F.col("_age") / (F.col("_groups") - 1))
    )
    title = K.trim_ws(F.coalesce("title", F.lit("")))
    scored = (
        pool.join(oldest_first.join(counts, "session"), ["session", "_group"])
        .withColumn("title", title)
        .where(
            (F.col("title") != "") & ~F.contains("title", F.lit("<"))
            & ~F.col("title").rlike(r"^[A-Za-z]:[\\/]") & ~is_fragment_title(F.col("title"))
            & (F.length("text") >= 80)
        )
    )
    score = (
        K.conclusion_score(F.col("text")) * 1.2
        + F.when(F.col("layer") == "summary", 0.6).otherwise(0.0)
        + F.least(F.lit(0.5), F.length("title") / 40.0)
        + F.when(F.col("title").rlike("^[0-9.、]"), -0.2).otherwise(0.0)
        + recency
    )
    return scored.withColumn("score", F.round(score, 9)).select(
        "session", "ord", "at", "title", "text", "score", "_at", "_o"
    )


def recap(records: DataFrame, max_tokens: int = 300) -> DataFrame:
    """``session, text, tokens, lines``: greedy by score with distinct titles and a budget.

    A line that does not fit is skipped and a cheaper one may follow, so this is not a running
    sum. But a kept line implies every better line of the same cost was kept or had a kept
    title: the best 12 distinct titles per cost are enough. That leaves at most 12 × budget rows
    per session for the final fold, whatever the session's size.
    """
    budget = max_tokens - _header_tokens()
    candidates = recap_candidates(records)
    said = conclusion_line(F.col("title"), F.col("text"))
    lines = candidates.withColumn(
        "line", F.concat(F.lit("- "), F.concat_ws(" — ", "title", F.nullif(said, F.lit(""))))
    ).withColumn("cost", K.estimate_tokens(F.col("line")) + 1).where(F.col("cost") <= budget)
    rank = F.struct(-F.col("score"), F.col("_neg_at"), -F.unix_millis(F.try_to_timestamp("_at")), "_o", "ord")
    lines = lines.withColumn("_neg_at", -F.coalesce(F.unix_millis(F.try_to_timestamp("at")), F.lit(0)))
    best = (
        lines.groupBy("session", "cost", "title")
        .agg(F.min_by(F.struct("line", "at"), rank).alias("b"), F.min(rank).alias("r"))
    )
    short = best.withColumn(
        "_n", F.row_number().over(Window.partitionBy("session", "cost").orderBy("r"))
    ).where(F.col("_n") <= MAX_LINES)

    def fold(acc: Column, x: Column) -> Column:
        take = (
            (F.size(acc["kept"]) < MAX_LINES)
            & (acc["used"] + x["cost"] <= budget)
            & ~F.exists(acc["kept"], lambda k: k["title"] == x["title"])
        )
        entry = F.struct(x["at"].alias("at"), F.size(acc["kept"]).alias("i"),
                         x["title"].alias("title"), x["line"].alias("line"))
        return F.struct(
            F.when(take, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(take, F.concat(acc["kept"], F.array(entry))).otherwise(acc["kept"]).alias("kept"),
        )

    zero = F.struct(
        F.lit(0).alias("used"),
        F.array().cast("array<struct<at:string,i:int,title:string,line:string>>").alias("kept"),
    )
    packed = short.groupBy("session").agg(
        F.array_sort(F.collect_list(
            F.struct("r", "cost", "title", F.col("b.line").alias("line"), F.col("b.at").alias("at"))
        )).alias("_ranked")
    ).select(
        "session", F.array_sort(F.aggregate("_ranked", zero, fold, lambda a: a["kept"])).alias("kept")
    )
    text = F.concat(
        F.lit(V.RECAP_HEADER + "\n"), F.array_join(F.transform("kept", lambda k: k["line"]), "\n")
    )
    return packed.where(F.size("kept") > 0).withColumn("text", text).select(
        "session", "text", K.estimate_tokens(F.col("text")).alias("tokens"),
        F.size("kept").alias("lines"),
    )
