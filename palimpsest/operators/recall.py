"""The recall block: one line per picked block, duplicate gates and the token budget."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.functions.counting import text_tokens
from palimpsest.functions.lines import line_of
from palimpsest.functions.titles import source_label
from palimpsest.functions.tokens import let
from palimpsest.operators.similar import similar_pairs
from palimpsest.session import settle, spread


def recall_line(title: Column, text: Column, max_chars: int = 300) -> Column:
    """One line for a block: title, lead, conclusions and a sample, at most ``max_chars``; made in batches."""
    limit = max(50, max_chars)

    def made(titles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array((line_of(a.as_py(), b.as_py(), limit) for a, b in zip(titles, texts)), pa.string())

    return F.arrow_udf(made, "string")(title.cast("string"), text.cast("string"))


def _token_set(text: str) -> Column:
    return F.array_distinct(text_tokens(F.col(text)))


def fresh_hits(
    picked: DataFrame,
    *,
    max_chars: int = 300,
    dedupe: bool = True,
    injected: DataFrame | None = None,
    boost: DataFrame | None = None,
) -> DataFrame:
    """Gate the picked blocks of each question; adds line and drop_reason (null = kept).

    ``picked``: query_id, session, place (1 or 2), fp, title, text. ``injected``: session, fp,
    line — what earlier turns already showed, however much it is; its lines meet the picked ones by likeness.
    ``boost``: session, boost — material queued for this turn.
    """
    ident = ["query_id", "session", "place"]
    rows = spread(picked, *ident).withColumn("line", recall_line(F.col("title"), F.col("text"), max_chars))
    no = F.lit(False)
    rows = rows.withColumns({
        "_line": _token_set("line"), "_body": _token_set("text"),
        "_title": K.trim_ws(F.coalesce("title", F.lit(""))),
        "_seen_fp": no, "_boosted": no, "_seen_text": no,
    })
    if dedupe and injected is not None:
        rows = settle(rows.drop("_seen_fp", "_seen_text"))
        fps = injected.where("fp is not null").select("session", "fp", F.lit(True).alias("_seen_fp")).distinct()
        shown = settle(injected.select("session", F.col("line").alias("_shown")).distinct())
        lines = settle(shown.withColumn("_line", _token_set("_shown")))
        alike = similar_pairs(rows, lines, ["session"], ["query_id", "place"], ["_shown"], "_line", V.NEAR_DUPLICATE)
        seen = alike.select(*ident, F.lit(True).alias("_seen_text")).distinct()
        rows = (
            rows.join(fps, ["session", "fp"], "left").join(seen, ident, "left")
            .withColumns({c: F.coalesce(c, no) for c in ("_seen_fp", "_seen_text")})
        )
    if dedupe and boost is not None:
        queued = boost.withColumn("_queued", _token_set("boost")).drop("boost")
        rows = rows.join(queued, "session", "left").withColumn(
            "_boosted", F.coalesce(K.containment(F.col("_line"), F.col("_queued")) >= V.NEAR_DUPLICATE, no)
        ).drop("_queued")
    gated = rows.withColumn(
        "_gate",
        F.when(F.col("_seen_fp"), "injected-fp")
        .when(F.col("_boosted"), "boost-overlap")
        .when(F.col("_seen_text"), "injected-text"),
    )
    # At most two blocks per question: the only possible twin is the first one, if it was kept.
    first = F.lag(
        F.when(F.col("_gate").isNull(), F.struct("_title", "_body", "_line"))
    ).over(Window.partitionBy("query_id", "session").orderBy("place"))
    twinned = gated.withColumn("_twin", first)
    same_title = (F.col("_title") != "") & (F.col("_twin._title") == F.col("_title"))
    similar = F.lit(dedupe) & (
        (K.jaccard(F.col("_body"), F.col("_twin._body")) >= V.NEAR_DUPLICATE)
        | (K.jaccard(F.col("_line"), F.col("_twin._line")) >= V.NEAR_DUPLICATE)
    )
    reason = F.coalesce(
        F.col("_gate"),
        F.when(F.col("_twin").isNotNull() & same_title, "same-title")
        .when(F.col("_twin").isNotNull() & similar, "near-duplicate"),
    )
    drop = [c for c in twinned.columns if c.startswith("_")]
    return twinned.withColumn("drop_reason", reason).drop(*drop)


def format_recall(
    fresh: DataFrame, *, max_items: int = 2, max_tokens: int = 700
) -> DataFrame:
    """``query_id, session, text, tokens, items, fps``; questions over budget give empty text."""
    rows = fresh.where("drop_reason is null and trim(line) <> ''").withColumn(
        "_line",
        F.concat(F.lit("- ["), source_label(F.col("src"), F.col("tool")), F.lit("] "), "line"),
    )
    grouped = rows.groupBy("query_id", "session").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("place", "_line", "fp"))), 1, max(1, max_items))
        .alias("_items")
    )

    def frame(body: Column) -> Column:
        return F.concat(F.lit(V.RECALL_HEADER + "\n"), body, F.lit("\n" + V.MARKER_END))

    def cost(body: Column) -> Column:
        return K.estimate_tokens(frame(body))

    def shrink(line: Column) -> Column:
        def step(keep: Column, _: Column) -> Column:
            over = cost(F.concat(line.substr(F.lit(1), keep), F.lit("…"))) > max_tokens
            return F.when((keep > 40) & over, F.floor(keep * 0.9).cast("int")).otherwise(keep)

        keep = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.length(line), step)
        return let(keep, lambda k: F.when(F.length(line) > k, F.concat(
            line.substr(F.lit(1), k), F.lit("…"))).otherwise(line))

    lines = F.transform("_items", lambda i: i["_line"])
    counts = F.reverse(F.sequence(F.lit(1), F.size("_items")))
    fit = F.get(
        F.filter(counts, lambda n: cost(F.array_join(F.slice(lines, F.lit(1), n), "\n")) <= max_tokens),
        F.lit(0),
    )
    body = F.when(
        fit.isNotNull(), F.array_join(F.slice(lines, F.lit(1), fit), "\n")
    ).otherwise(shrink(F.get(lines, F.lit(0))))
    out = grouped.withColumn("_body", body).withColumn(
        "_n", F.coalesce(fit, F.lit(1))
    ).withColumn("_tokens", cost(F.col("_body")))
    ok = (F.col("_tokens") <= max_tokens) & F.lit(max_items > 0 and max_tokens > 0)
    return out.select(
        "query_id", "session",
        F.when(ok, frame(F.col("_body"))).otherwise("").alias("text"),
        F.when(ok, F.col("_tokens")).otherwise(0).alias("tokens"),
        F.when(ok, F.col("_n")).otherwise(0).alias("items"),
        F.when(ok, F.array_join(F.transform(F.slice("_items", F.lit(1), F.col("_n")),
                                            lambda i: i["fp"]), " ")).otherwise("").alias("fps"),
    )
