"""Token counts, token store, main text, archives: against brute force on small odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from palimpsest.llm import archives, chunked, html_text, token_counts, token_store
from palimpsest.llm.chunked import ChunkIds

ODD = [
    None, "", " ", "\n \t", "The cat sat.", "the  cat\n\nsat , on'ts I'LL 12345", "İİx ćd ÀÉ", "x" * 300, "<|endoftext|>x <|startoftext|>",
    "ß…“q”", "漢字かな 한국어", "é́ é x", "foo\x1cq!\x1cx", "a᠎ b", "hi  \u180e there\xa0\u180e", "\u180e \u180e é x<|endoftext|>\u180e",
    "word " * 900, "end.", "end.",
]


def lib(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def rows(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_counts_match_library_at_every_prefix(spark):
    t = lib("word_bpe_49k.json")
    counter = token_counts.PrefixCounter()
    for text in ODD:
        (steps,) = counter.steps([text])
        text = text or ""
        assert len(steps) == len(text)
        for k in sorted({*range(min(len(text), 60) + 1), len(text)}):
            assert token_counts.tokens_before(steps, k) == len(t.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_token_counts_rows(spark):
    t = lib("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in token_counts.token_counts(rows(spark, ODD), limit=40).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 40)
        cut = got[i]["cut_chars"]
        assert len(t.encode((text or "")[:cut], add_special_tokens=False).ids) <= 40
    assert token_counts.token_counts(rows(spark, []), limit=40).count() == 0


def test_counts_of_odd_spaces_and_letters():
    rng = random.Random(3)
    t, counter = lib("word_bpe_49k.json"), token_counts.PrefixCounter()
    parts = [" ", "  ", "\u180e", "\xa0", "\n", "hi", "there", "é", "e\u0301", "İ", "ß", ",", ".", "<|endoftext|>", "中", "1", "'s", "A", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    for text, steps in zip(texts, counter.steps(texts)):
        for k in range(len(text) + 1):
            assert token_counts.tokens_before(steps, k) == len(t.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_stored_arrays_answer_again(spark):
    from pyspark.sql import functions as F

    stored = rows(spark, ODD).select("doc_id", token_counts.prefix_counts(F.col("text")).alias("steps"))
    got = stored.select("doc_id", token_counts.answers(F.col("steps"), 5).alias("a")).select("doc_id", "a.*")
    want = token_counts.token_counts(rows(spark, ODD), limit=5).drop("n_bytes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_chunked_ids_match_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, c = lib(name), ChunkIds(name)
        for text, ids in zip(ODD, c.encode(ODD)):
            assert np.frombuffer(ids, c.dtype).tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_words_go_to_the_model_and_the_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(chunked, "ID_ENTRIES", 5)
    monkeypatch.setattr(chunked, "LATEST_ENTRIES", 7)
    t, c = lib("byte_bpe_50k.json"), ChunkIds("byte_bpe_50k.json")
    words = [a + b + e for a in ("über", "Año", "qu") for b in ("ll", "Ñý", "zz") for e in ("ÿa", "B", "thing")]
    texts = [" ".join(words[i:] + words[:i]) for i in range(0, 27, 4)] + [" ".join(words[:5] * 9)]
    wanted = [t.encode(x, add_special_tokens=False).ids for x in texts]

    class ModelOnly:
        model = c.tokenizer.model

    c.tokenizer = ModelOnly()
    assert [np.frombuffer(ids, c.dtype).tolist() for ids in c.encode(texts)] == wanted
    assert len(c.memo) == 5 and len(c.memo.latest) <= 7


def brute_store(pairs):
    t = lib("byte_bpe_50k.json")
    out, start = [], 0
    coded = sorted(((k is not None, k or 0), np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, x in pairs)
    for (full, k), raw in coded:
        out.append((k if full else None, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


@pytest.mark.parametrize("shard_bytes", [64, 4 << 20])
def test_store_reads_back(spark, shard_bytes):
    pairs = [(7 * i % 31, x) for i, x in enumerate(ODD)] + [(None, "no number"), (100, "a b"), (100, "c"), (100, "c")]
    docs = spark.createDataFrame([(k, x, 1) for k, x in pairs], "doc_id long, text string, start int")
    got = token_store.stored_documents(docs, shard_bytes=shard_bytes)
    same_order = [(k, s, n, c) for k, s, n, c in brute_store(pairs)]
    got = sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=lambda r: r[1])
    assert [r[:2] for r in got if r[0] != 100] == [r[:2] for r in same_order if r[0] != 100]
    assert sorted((r[2:] for r in got)) == sorted((r[2:] for r in same_order))
    assert [r[0] for r in got] == [r[0] for r in same_order]
    assert token_store.stored_documents(docs.limit(0)).count() == 0


def test_fetch_by_key(spark, tmp_path):
    docs = rows(spark, ODD)
    buckets = token_store.write_store(docs, str(tmp_path / "store"))
    keys = spark.createDataFrame([(4, 0), (14, 0), (999, 0)], "key long, occurrence int")
    got = {r["key"]: r["ids"] for r in token_store.fetch(spark, str(tmp_path / "store"), keys, buckets).collect()}
    t = lib("byte_bpe_50k.json")
    assert got == {k: [*t.encode(ODD[k], add_special_tokens=False).ids, 0] for k in (4, 14)}


def test_minimal_perfect_hash():
    for n in (1, 2, 7, 500):
        h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        seeds, slots = token_store.build_hash(h)
        assert sorted(slots) == list(range(n))
        assert (token_store.find_slots(h, seeds, n) == slots).all()


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>menu</a></li></ul></nav><header>site</header><!-- x --><div class='ad'>buy</div>"
    "@<aside>side</aside><div class='cookie-notice'>ok?</div><form>f<input></form>"
    "<section id='comments'><p>reader said a very long thing here, longer than it should be</p></section><footer>&copy; f</footer>"
)


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Ti&amp;tle</h1><p><b>bo</b>ld one.<br><p>Two\n  three &lt;x&gt;</p></article>", "Ti&tle bold one. Two three <x>"),
    ("<article><h1>T</h1><p>short</p><div class='share'>no</div><footer>no</footer></article>", "T short"),
    ("<main><h1>T</h1><div><p>One long paragraph, with text.</p><p>And another one, as long.</p></div></main>", "T One long paragraph, with text. And another one, as long."),
    ("<div id='post'><h1>T</h1><div><p>One long paragraph, with text.</p><p>And another one, as long.</p></div></div>", "T One long paragraph, with text. And another one, as long."),
    ("<article></article>", ""),
])
def test_main_text(body, text):
    assert html_text.extract(PAGE.replace("@", body)) == text


LONG = "This sentence of the article is long enough to be read as running text, and one more follows it here. "
TAIL = "<p>" + LONG * 4 + "</p>"


@pytest.mark.parametrize("body", [
    "<div class='content has-sidebar'><h1>T</h1>@</div>",
    "<div class='layout sidebar-right'><h1>T</h1>@</div>",
    "<div class='modalPage'><main><h1>T</h1>@</main></div>",
    "<form id='aspnetForm' action='x'><div><h1>T</h1>@</div><input></form>",
    "<form><article><h1>T</h1>@</article></form>",
    "<article><h1>T</h1>@<section id='discussion'><h2>D</h2><p>short</p></section></article>",
    "<article><h1>T</h1>@<h2 id='related-work'>Related work</h2><p>short</p></article>",
    "<article><h1>T</h1>@<div id='side-effects'><h2>S</h2>@</div><p id='share-price'>" + LONG + "</p></article>",
    "<article><h1>T</h1>@<section id='search'><p>s</p></section><section class='menu'><p>m</p></section></article>",
    "<div id='post'><h1>T</h1>@@<section id='response-form'><h2>R</h2>@</section></div>",
])
def test_names_alone_drop_no_article_text(body):
    body = body.replace("@", TAIL)
    want = " ".join(re.sub(r"<[^>]*>", " ", body).split())
    assert html_text.extract(PAGE.replace("@", body)) == want
    assert html_text.extract(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("junk", [
    "<div class='share'>Share this</div>", "<div class='related'><a href='a'>" + LONG + "</a></div>", "<div class='ad-slot'>" + LONG + "</div>",
    "<section id='comments'>" + TAIL * 9 + "</section>", "<ol class='commentlist'><li><article class='comment'>" + TAIL + "</article></ol>",
    "<form><p>" + LONG + "</p></form>", "<div class='newsletter'><h2>News</h2>" + LONG + "</div>", "<section class='related'><a href='a'>x</a></section>",
])
def test_confirmed_names_are_dropped(junk):
    want = " ".join(("T " + LONG * 8).split())
    assert html_text.extract(PAGE.replace("@", "<article><h1>T</h1>" + TAIL + junk + TAIL + "</article>")) == want
    assert html_text.extract(PAGE.replace("@", "<div id='post'><h1>T</h1>" + TAIL + TAIL + "</div>" + junk)) == want


@pytest.mark.parametrize("name", [
    "comments-open", "comments-closed", "disqus-enabled", "single-comment-page", "post-comments-off", "comment-status-open", "comments",
])
def test_a_state_of_comments_is_no_list_of_comments(name):
    want = " ".join(("T " + LONG * 8).split())
    comments = f"<ol class='commentlist'><li class='comment'>{TAIL}</ol>"
    for tag in ("div", "section"):
        body = f"<main><{tag} class='post {name}'><h1>T</h1>{TAIL}{TAIL}{comments}</{tag}></main>"
        assert html_text.extract(PAGE.replace("@", body)) == want
    code = "<article><h1>T</h1>" + TAIL + "<pre class='code comment'>x = 1</pre>" + TAIL + "</article>"
    assert "x = 1" in html_text.extract(PAGE.replace("@", code))


def test_an_advert_longer_than_the_article_goes():
    assert html_text.extract(f"<div class='ad'>{LONG}</div><article><h1>T</h1><p>short</article>") == "T short"


@pytest.mark.parametrize("outer", ["@", "<div>@</div>", "<main>@</main>"])
def test_densities_choose_on_pages_with_articles_too(outer):
    links = "<ul>" + "".join(f"<li><a href='{i}'>go to place {i}</a></li>" for i in range(9)) + "</ul>"
    first, second = f"<article><h1>One</h1>{TAIL}{TAIL}</article>", f"<article><h2>Two</h2>{TAIL}<p>short</p></article>"
    want = " ".join(f"One {LONG * 8} Two {LONG * 4} short".split())
    assert html_text.extract(PAGE.replace("@", outer.replace("@", first + links + second))) == want
    inner = f"<article><h1>T</h1><p>by x</p><div class='text'>{TAIL}{TAIL}</div><p>end</p></article>"
    assert html_text.extract(PAGE.replace("@", outer.replace("@", inner))) == " ".join(f"T by x {LONG * 8} end".split())


def test_main_text_rows(spark):
    data = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p>plain", "x"), (3, "u", "<p>plain", "x"), (4, "u", "<script>x", "x"), (5, "u", "a < b <a '", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extracted(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "plain", 5), (3, "plain", 5), (4, "", 0), (5, "a < b", 5)]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_hostile_pages_stay_linear():
    for page in ("<div>" * 5000, "<" * 50000 + ">", "<a '" * 5000 + ">", "<li><ul>" * 2000, "<b><p>" * 2000 + "</b>" * 2000):
        html_text.extract(page)


def test_archives(spark):
    long, other = "x" * 1500, "é" * 600
    data = [(1, "http://a/ b", long), (9, None, long), (4, "http://a", long), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""),
            (None, "u", other), (3, "http://ü", other), (3, "http://ü", other), (2, "u", "WARC/1.1\r\n\r\nfiledesc://\n" * 80)]
    pages = spark.createDataFrame([(*r, 0) for r in data], "page_id long, url string, html string, record_type int")
    got = archives.archived(pages).collect()
    assert len(got) == len(data)
    for r in got:
        payloads = {(h or "").encode() for i, _, h in data if i == r["page_id"]}
        assert r["payload_digest"] in {hashlib.sha1(p).hexdigest() for p in payloads}
        assert r["payload_bytes"] in {len(p) for p in payloads}
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0) for r in got)
    assert kinds == [(0, "revisit", 3), (1, "revisit", 9), (2, "response", 0), (3, "response", 0), (3, "revisit", 3), (4, "revisit", 9),
                     (5, "response", 0), (6, "response", 0), (7, "response", 0), (8, "response", 0), (9, "response", 0)]
    for some in (0, 1, 2):
        assert archives.archived(pages.limit(some).repartition(16)).count() == some


def test_arc_versions_and_faults():
    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    for version in (1, 2):
        extra = b"" if version == 1 else b" 200 c - 5 f"
        raw = archives.version_block(version, "n") + b"\nhttp://a 1.2.3.4 20200102030405 text/html" + extra + b" %d\n" % len(body) + body + b"\n"
        ((_, fields, block),) = list(archives.parse_arc(raw))
        made = archives.capture(fields, block)
        assert (block, made["date"], made["type"], made["payload"]) == (body, "2020-01-02T03:04:05Z", "response", b"hi")
        with pytest.raises(ValueError):
            list(archives.parse_arc(raw[:-5]))
    assert re.match(r"<urn:uuid:[0-9a-f-]{36}>$", made["id"])
