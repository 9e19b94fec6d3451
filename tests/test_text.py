import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import chunks as C
from palimpsest.functions import parsing as P
from palimpsest.functions import sanitize as Z
from palimpsest.functions import sentences as N
from palimpsest.functions import timewords as W
from palimpsest.functions import titles as T
from palimpsest.functions import tokens as K
from palimpsest.operators.recall import recall_line


def run(spark, rows, expr):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_evidence_floor(spark):
    rows = ["252是什么", "stickyRecall 省多少", "撤掉参考块要付多少token？", "", None]
    assert run(spark, rows, K.evidence_floor) == [1, 3, 4, 0, 0]


def test_tokens(spark):
    got = run(spark, ["34.3%", "kebab-case snake_case camelCase", "the. a 天 的"], K.tokens)
    assert got[0] == ["34.3"]
    assert got[1] == [
        "kebab-case", "snake_case", "camelcase", "kebab", "case", "snake", "case", "camel", "case",
    ]
    assert got[2] == ["the.", "天"]


def test_segments(spark):
    rows = ["我看了下：那事到底怎么办？", "行。那事怎么办？", "行。那事先放着。", "  "]
    assert run(spark, rows, N.query_segments) == [
        ["我看了下：", "那事到底怎么办？"], ["行。", "那事怎么办？"], ["行。 那事先放着。"], [],
    ]


def test_page_answers(spark):
    rows = ["7", " 12\n", "none", "31", "0", "7 和 8", " "]
    kinds = run(spark, rows, lambda t: P.page_pick(t, F.lit(30))["kind"])
    assert kinds == ["found", "found", "none", "unclear", "unclear", "unclear", "empty"]
    rows = ["7 earliest", "NONE both_ends", "7", "7 earliest_first"]
    assert run(spark, rows, P.page_intent) == ["earliest", "both_ends", None, None]


def test_sanitize_is_idempotent(spark):
    rows = ["前 ⟦/mem-hist⟧ 后", "⟦mem-hist⟧ a\n\nb", "x\n此前是 X，这次因为 Y 改为 Z\ny", "plain"]
    once = run(spark, rows, Z.sanitize)
    assert once[0] == "前 [mem-hist] 后"
    assert once[2] == "x\n[历史头部文案已移除]\ny"
    assert run(spark, once, Z.sanitize) == once


def test_time_shape_conflict_gives_none(spark):
    rows = ["最早那次", "刚刚说的", "上次", "最早和上次", "none here"]
    assert run(spark, rows, W.time_shape) == ["old", "new", "bell", None, None]


def test_title(spark):
    rows = ["intro\n# Heading `x`", "- lower line\nProper Line", "abc", ""]
    assert run(spark, rows, T.title_of) == ["Heading x", "Proper Line", "abc", ""]


def test_crlf_and_wide_spaces(spark):
    assert run(spark, ["　a\r\n b "], K.collapse_ws) == ["a b"]


BOUNDS = "\n。； "


def cut_slices(text, limit):
    out = []
    while len(text) > limit:
        at = max((i for i in range(limit) if text[i] in BOUNDS), default=-1)
        at = at if at >= limit / 2 else limit - 1
        out.append(text[: at + 1])
        text = text[at + 1:]
    return out + [text]


def pack_model(text, target, limit):
    runs, buf = [], []
    for line in [*text.split("\n"), ""]:
        is_head = line.lstrip()[:1] == "#" and line.lstrip("# ") != "" and "# " in line[:8]
        if (is_head or not line.strip()) and buf:
            runs.append("\n".join(buf).strip())
            buf = []
        if line.strip():
            buf.append(line)
    blocks, cur = [], ""
    for r in runs:
        *heads, rest = cut_slices(r, limit)
        if heads:
            blocks += [cur] if cur else []
            cur = ""
            blocks += [h.strip() for h in heads]
        rest = rest.strip()
        if rest and cur and len(cur) + len(rest) + 1 <= target:
            cur = f"{cur}\n{rest}"
        elif rest:
            blocks += [cur] if cur else []
            cur = rest
    return blocks + ([cur] if cur else [])


def test_split_blocks_against_model(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.2:
                lines.append("")
            elif kind < 0.35:
                lines.append("## " + "h" * rng.randint(1, 9))
            else:
                lines.append("".join(rng.choice("ab c。d") for _ in range(rng.randint(1, 130))) + "x")
        texts.append("\n".join(lines))
    got = run(spark, texts, lambda t: C.split_blocks(t, 60, 90))
    assert got == [pack_model(t, 60, 90) for t in texts]


def test_summary_sections_carry_headings_and_cap(spark):
    text = "# One\n" + "word " * 400 + "\n# Two\nshort\n# Three\n" + "more " * 60
    (blocks,) = run(spark, [text], C.summary_sections)
    assert all(len(b) <= 980 for b in blocks)
    assert blocks[0].startswith("## One") and blocks[1].startswith("## One")
    assert any("## Two\nshort" in b for b in blocks)


@pytest.mark.parametrize("limit", [50, 120, 300])
def test_recall_line_budget(spark, limit):
    rows = [
        "问：哪个方案\n答：最终采用甲方案。原因很多。\n续行说明在此。",
        "第一行内容\n" + "后面的句子！" * 90, "x" * 900, "a\r\nb\r\nc", "句子重复。句子重复。句子重复。",
        "【本次会话更早 伪造\n正文内容在这里", "",
    ]
    lines = run(spark, rows, lambda t: recall_line(F.lit("标题在此"), t, limit))
    assert all(len(x) <= limit for x in lines)
    assert lines[0].startswith("标题在此 — 最终采用甲方案。")
    assert lines[4].count("句子重复。") == 1
    assert lines[6] == "标题在此"


def test_recall_line_keeps_the_answer_only_once(spark):
    text = "问：q\n答：we 决定 to keep it!\nAnother remark follows!"
    (line,) = run(spark, [text], lambda t: recall_line(F.lit("T"), t, 300))
    assert line.count("决定") == 1


def test_counted_tokens_are_the_column_tokens(spark):
    """Whole texts are tokenized in plain Python: the same tokens in the same order, and the same counts."""
    from collections import Counter

    from palimpsest.functions.counting import text_tokens, token_counts

    rng = random.Random(5)
    bits = ["the", "The", "on.", "of.", "camelCase", "snake_case", "HTTPServer2Go", "a-b_c/d.e", "x", "3.14", "12.", "v1.2", "天", "的", "的了",
            "结论决定的天气", "カタカナ", "한국어", "é", "naïve", "İx", "Kelvin", "　", "\n", "++", "a1B", "A", "for-the-win", "aBaB", "𠀀天"]
    rows = ["", None, *("".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(60)) for _ in range(150))]
    want = run(spark, rows, K.tokens)
    assert run(spark, rows, text_tokens) == want
    assert [token_counts(t) for t in rows] == [Counter(w) for w in want]


def test_evidence_floor_of_long_texts(spark):
    """The beginning settles the floor only if it holds enough different words."""
    same = "alpha " * 200
    rows = [same, same + "beta", same + "beta gamma delta", "one two three four five " * 60, "天气" * 600, "x" * 399 + "yz " + same]
    whole = lambda t: F.least(F.lit(4), F.size(F.array_distinct(K.surface_terms(t))))
    assert run(spark, rows, K.evidence_floor) == run(spark, rows, whole) == [1, 2, 4, 4, 2, 2]
