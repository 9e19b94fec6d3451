"""Recall lines and folded repeats of whole texts, made where the texts lie."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from palimpsest.catalog.recall_sql import line_ctes
from palimpsest.functions.lines import folded, line_of, sentences
from palimpsest.functions.sentences import fold_adjacent_sentences, sample_head_tail, split_sentences
from palimpsest.operators.recall import recall_line

BITS = [
    "问：", "答：", "\n", "\n", "。", "！", "!", ";", " ", "  ", "**", "#", "- ", "> ", "决定", "最终采用", "|", "---", "word", "the plan",
    "长句子的内容在这里说明一下", "a", "标题", "𠀀𠀁", "é", "x" * 45, "y" * 70 + "!", "句子重复。" * 3, "Hello there general statement number one! ",
]


def texts(count, seed):
    rng = random.Random(seed)
    return [rng.choice(["", "问：q\n答："]) + "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 3, 8, 20, 60]))) for _ in range(count)]


def test_recall_lines_against_sql(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", "标题", "t" * 44, "t" * 280, "word"]), t) for i, t in enumerate(texts(300, 3))]
    made = spark.createDataFrame(rows, "i int, title string, text string").select("i", recall_line(F.col("title"), F.col("text")).alias("line"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    db = duckdb.connect()
    db.execute("CREATE TABLE src (i INT, title VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO src VALUES (?, ?, ?)", rows)
    want = dict(db.execute(f"WITH {line_ctes('src', 'lines')} SELECT i, line FROM lines").fetchall())
    assert {r.i: r.line for r in made.collect()} == want


def test_a_long_text_is_linear():
    """20,000 sentences of the first line meet 20,000 others."""
    first, second = (" ".join(f"{w} statement {i} of a long report!" for i in range(20_000)) for w in ("One", "Other"))
    begun = time.time()
    line = line_of("T", f"{first}\n{second}\n{first}", 300)
    assert time.time() - begun < 20 and len(line) <= 300 and line.startswith("T — One statement 0 ")
    assert line_of(None, None, 300) == "" and line_of("T", None, 300) == "T"


def test_folded_in_batches(spark):
    rows = [None, "", "abc", *texts(200, 5)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    split = {r.i: r.s for r in df.select("i", split_sentences(F.col("t")).alias("s")).collect()}
    assert [sentences(t) for t in rows] == [split[i] for i in range(len(rows))]
    for times in (1, 2, 5):
        out = df.select("i", fold_adjacent_sentences(F.repeat("t", F.lit(times))).alias("f"))
        assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
        assert {r.i: r.f for r in out.collect()} == {i: folded(t and t * times) for i, t in enumerate(rows)}
    assert folded("One thing is said! " * 4) == "One thing is said!" and folded("eight ch" * 6 + "!" + "eight ch" * 6 + "!") == "eight ch" * 6 + "!"
    assert [r.x for r in df.select(sample_head_tail(F.lit("a" * 30), 11).alias("x")).limit(1).collect()] == ["a" * 7 + "…" + "a" * 3]
