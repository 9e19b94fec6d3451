"""Tool results: pairing with calls, filtering, target names, clamping and budget."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import vocab as V
from palimpsest.functions import tokens as K
from palimpsest.functions.sanitize import sanitize, strip_markers
from palimpsest.operators.packing import running_budget


def allowed_tool(name: Column, names: str = V.TOOL_NAMES) -> Column:
    wanted = [n for n in names.replace("，", ",").replace(",", " ").split() if n]
    if "*" in wanted:
        return F.lit(True)
    return F.coalesce(name, F.lit("")).isin(wanted)


def _first_argument(args: Column, keys: list[str]) -> Column:
    def text(key: str) -> Column:
        return F.nullif(K.trim_ws(F.get_json_object(args, f"$.{key}")), F.lit(""))

    return F.coalesce(*(text(k) for k in keys))


def tool_target(name: Column, args: Column) -> Column:
    """Last two path parts of the first non-blank argument, else the tool name."""
    parts = F.split(F.replace(_first_argument(args, V.TOOL_TARGET_KEYS), F.lit("\\"), F.lit("/")), "/")
    tail = F.slice(parts, -F.least(F.lit(2), F.size(parts)), F.lit(2))
    return F.coalesce(F.array_join(tail, "/"), name, F.lit(""))


@F.pandas_udf(T.BooleanType())
def _inside(target: pd.Series, cwd: pd.Series, root: pd.Series) -> pd.Series:
    def check(t, base, top):
        if not t or not top:
            return False
        path = posixpath.normpath(posixpath.join(base or "/", t))
        top = posixpath.normpath(top)
        return path != top and path.startswith(top.rstrip("/") + "/")

    return pd.Series([check(*row) for row in zip(target, cwd, root)], dtype="boolean")


def reads_own_store(args: Column, cwd: Column, root: Column) -> Column:
    """Whether the call's path argument resolves strictly inside ``root``."""
    return _inside(F.coalesce(_first_argument(args, V.TOOL_PATH_KEYS), F.lit("")), cwd, root)


def clamp_text(clean: Column, limit: Column) -> Column:
    """Cut sanitized text to ``limit`` characters including the note of its full length."""
    n = F.length(clean)
    note = F.concat(F.lit(V.TOOL_CUT_NOTE[0]), n.cast("string"), F.lit(V.TOOL_CUT_NOTE[1]))
    body = F.greatest(F.lit(1), limit - F.length(note))
    return F.when(n <= limit, clean).otherwise(F.concat(clean.substr(F.lit(1), body), note))


def tool_header(name: Column, target: Column) -> Column:
    return F.concat(F.lit(V.TOOL_HEADER_START), name, F.lit(V.TOOL_HEADER_MIDDLE), target, F.lit(V.TOOL_HEADER_END))


def body_of(text: Column) -> Column:
    """Stored tool text without its header and truncation note."""
    bare = F.regexp_replace(text, V.TOOL_HEADER_PATTERN, "")
    return F.regexp_replace(bare, V.TOOL_CUT_PATTERN, "")


def target_of(text: Column, title: Column) -> Column:
    """Target named in a stored header, else in the title."""
    from_text = F.regexp_extract(text, V.TOOL_TARGET_PATTERN, 1)
    from_title = F.regexp_extract(title, V.TOOL_TITLE_PATTERN, 1)
    return F.when(from_text != "", from_text).otherwise(from_title)


def pair_calls(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Left join results to the last call with their id; unmatched results get an empty name."""
    last = calls.groupBy("session", "call_id").agg(
        F.max_by(F.struct("name", "args"), "seq").alias("call")
    )
    return results.join(last, ["session", "call_id"], "left").select(
        *results.columns,
        F.coalesce("call.name", F.lit("")).alias("name"),
        F.col("call.args").alias("args"),
    )


WHOLE_TEXT = (1 << 31) - 1


def tool_blocks(
    results: DataFrame, calls: DataFrame, key: str, *, names: str = V.TOOL_NAMES,
    max_chars: int = 0, budget: int = 0, cwd: str = "/", own_root: str = "",
) -> DataFrame:
    """Kept tool results as blocks: ``key, seq, name, target, title, text, truncated``.

    ``results``: session, key, seq, call_id, is_error, text. ``seq`` is unique within ``key``.
    Results of reading files inside ``own_root`` are left out. Texts are whole and all results are kept unless
    ``max_chars`` (200 to 20,000 per text) or ``budget`` (per key) ask for less.
    """
    limit = max(200, min(20_000, max_chars)) if max_chars > 0 else WHOLE_TEXT
    paired = pair_calls(results, calls)
    if own_root:
        paired = paired.where(~reads_own_store(F.col("args"), F.lit(cwd), F.lit(own_root)))
    usable = (
        paired.where(~F.coalesce("is_error", F.lit(False)) & allowed_tool(F.col("name"), names))
        .withColumn("text", K.trim_ws(strip_markers(F.col("text"))))
        .where("text <> ''")
        .withColumn("target", tool_target(F.col("name"), F.col("args")))
        .withColumn("_clean", sanitize(F.col("text")))
        .withColumn("_header", tool_header(F.col("name"), F.col("target")))
        .withColumn("_room", F.greatest(F.lit(1), F.lit(limit) - F.length("_header")))
    )
    body = clamp_text(F.col("_clean"), F.col("_room"))
    blocks = usable.select(
        "session", key, "seq", "name", "target",
        F.substring(F.concat(F.lit("工具 "), "name", F.lit("："), "target"), 1, 60).alias("title"),
        F.substring(F.concat("_header", body), 1, limit).alias("text"),
        (F.length("_clean") > F.col("_room")).alias("truncated"),
    ).withColumn("chars", F.length("text"))
    return running_budget(blocks, key, "seq", "chars", budget)
