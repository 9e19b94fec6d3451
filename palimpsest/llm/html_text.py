"""Main text of web pages by composite text density.

Each page becomes a DOM. Subtrees that are never part of an article (menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are cut off by element and role. A form or a
word of a class or id only makes a candidate: it stays if it holds most of the page's text or its main element,
and inside the article if it is a heading or, under a word that an article may be about as well, a section or
running text that is not mostly links. Every remaining node gets its composite text density: characters per tag, adjusted for the share of
linked characters and tags and for the share of links in the body. The node whose children's densities sum
highest is the core; the lowest density on its path to the body is the threshold, and every part of the page
at or above it belongs to the text, on pages with an article element too. That element adds the headings and
blocks around the core. Between the dense parts only lists of links below the threshold are left out; nothing is
dropped for being short.

Defined results: a null, empty or text-free page gives an empty text. References are decoded as in HTML 5,
white space becomes one space, blocks join by one space. Unclosed and misnested tags are closed as browsers
do; unclosed scripts run to the end. Work and memory grow with the page alone; pages are independent rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template iframe svg canvas object embed nav aside footer form button select "
    "option textarea title head dialog menu noembed noframes audio video map".split()
) - {"form"}
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split()
)
#: Class and id words of parts that are not the article.
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars aside rail widget widgets related recommended recommendations menu menus nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer footers copyright share sharing social comment comments "
    "commentlist discussion responses disqus replies reply respond side form login signup search pagination pager toolbar".split()
)
#: Those of them that an article's own parts may be named after, too.
DOUBTFUL = frozenset(
    "notice notices alert alerts aside rail related recommended recommendations menu menus share sharing "
    "discussion responses replies reply respond side form search".split()
)
READERS = frozenset("comment comments commentlist disqus".split())
#: Beside a word of ``READERS`` these tell of a state or a kind of page, not of a list of comments.
STATES = frozenset("open opened closed off on enabled disabled allowed count single page status".split())
#: A class that starts so tells what a part has beside it or inside, not what it is.
HAVING = re.compile(r"(?:has|have|with|without|no|non|hide)[-_]", re.I)
#: How sure it is that a node is apart: not at all, by a word with another sense, by a word, by readers, for certain.
FREE, DOUBT, LIKELY, BY_READERS, GONE = range(5)
#: Characters outside links from which a block counts as running text.
PROSE = 80
#: Words of page headers, cut off only outside the article itself.
HEADERS = frozenset("header headers topbar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
LISTS = frozenset("ul ol dl table select menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

COMMENT = r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|</[^a-zA-Z>][^>]*>"
NAMED = r"<(/?)([a-zA-Z][^\s/>]*)"
QUOTED = NAMED + r"((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
SIMPLE = NAMED + r"([^>]*)>"
MARKUP = re.compile(f"{QUOTED}|{SIMPLE}|{COMMENT}", re.S)
#: For the rest of a page once a quote is found that nothing closes.
UNQUOTED = re.compile(f"{SIMPLE}|{SIMPLE}|{COMMENT}", re.S)
UNENDED = re.compile(r"<[a-zA-Z/!?].*\Z", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@-][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Page:
    """The DOM as parallel lists in document order; a node's text is one run of ``pieces``."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.dropped, self.article = ["body"], [-1], [False], [False]
        self.doubt = [FREE]
        self.first, self.last = [0], [0]
        self.pieces: list[str] = []
        self.own: list[int] = [0]
        self._read(source)
        self._settle()

    def _apart(self, tag: str, attributes: str, in_article: bool) -> int:
        if tag in DROPPED or (tag == "header" and not in_article):
            return GONE
        found = LIKELY if tag == "form" else FREE
        if not attributes.strip():
            return found
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                for part in value.split():
                    if not HAVING.match(part):
                        found = max(found, self._named(tag, name, part, in_article))
            elif name == "role" and value.lower() in ROLES:
                return GONE
            elif name == "role" and value.lower() == "form":
                found = max(found, LIKELY)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return GONE
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return GONE
        return found

    def _named(self, tag: str, name: str, part: str, in_article: bool) -> int:
        words = {w.lower() for w in SPLIT_WORDS.split(part) if w}
        if words & READERS and (words & STATES or tag in ("pre", "code")):
            words -= READERS
        apart = words & APART
        if tag in ("body", "html", "main", "article"):
            return BY_READERS if "comment" in words and apart else FREE
        if apart & READERS:
            return BY_READERS
        if apart:
            # an id of several words, as of "cookie-policy-in-europe", may be made from a heading
            return DOUBT if apart <= DOUBTFUL or (name == "id" and words - APART) else LIKELY
        return LIKELY if words & HEADERS and not in_article and tag not in HEADINGS else FREE

    def _settle(self) -> None:
        """Drop the candidates that their size, links or place confirm."""
        n = len(self.tag)
        self.cut: list[tuple[int, int]] = []
        if not any(self.doubt):
            return
        linked, inside, readers = [False] * n, [False] * n, [False] * n
        plain, links, mains, tops = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            p = self.parent[i]
            linked[i] = linked[p] or self.tag[i] == "a"
            readers[i] = readers[p] or self.doubt[i] == BY_READERS
        for i in range(n - 1, -1, -1):
            own = 0 if self.dropped[i] else self.own[i]
            plain[i] += own * (not linked[i])
            links[i] += own * linked[i]
            mains[i] += self.tag[i] == "main" and not self.dropped[i] and not readers[i]
            tops[i] += self.tag[i] == "h1"
            if i and not self.dropped[i]:
                p = self.parent[i]
                tops[p] += tops[i]
                plain[p] += plain[i]
                links[p] += links[i]
                mains[p] += mains[i]
        by_readers = sum(plain[i] for i in range(n) if readers[i] and not readers[self.parent[i]])
        total = plain[0] - by_readers
        articles = [i for i in range(n) if self.tag[i] == "article" and not self.dropped[i] and not readers[i]]
        largest = max(articles, key=lambda i: plain[i], default=0)
        holders = set()
        if 4 * plain[largest] < total:
            largest = 0
        while largest:
            holders.add(largest)
            largest = self.parent[largest]
        has_article = bool(mains[0] or articles)

        def holds(i: int) -> bool:
            if self.doubt[i] == BY_READERS and tops[i] and tops[i] == tops[0] and 2 * plain[i] > plain[0]:
                return True  # the page's heading and most of its text: named after its comments, but not they
            if self.doubt[i] == BY_READERS:
                # nothing but these on a page without an article: its text is what readers wrote
                return not has_article and total < PROSE and plain[i] > plain[0] / 2
            # beside an article, a short one too, an advert of a few lines is not most of the page
            beside = has_article and not self.article[self.parent[i]] and not mains[i] and i not in holders
            most = 2 * plain[i] > total and (not beside or plain[i] >= 10 * PROSE)
            return most or bool(mains[i]) or i in holders

        def prose(i: int) -> bool:
            return plain[i] >= PROSE and plain[i] > links[i]

        def stays(i: int) -> bool:
            if self.tag[i] in HEADINGS:
                return True
            return self.doubt[i] == DOUBT and (prose(i) or (self.tag[i] == "section" and plain[i] > links[i]))

        candidates = [i for i in range(1, n) if self.doubt[i] and not self.dropped[i]]
        held = {i for i in candidates if holds(i) or (self.doubt[i] == DOUBT and prose(i) and 4 * plain[i] >= total and not has_article)}
        hard = list(self.dropped)

        def decide(core: int | None) -> None:
            for i in range(1, n):
                p = self.parent[i]
                inside[i] = inside[p] or i == core
                within = self.article[p] or inside[p]
                gone = bool(self.doubt[i]) and i not in held and not (core is not None and within and stays(i))
                self.dropped[i] = hard[i] or self.dropped[p] or gone

        decide(None)
        if any(i for i in candidates if i not in held and stays(i)):
            _, sums, _ = self.densities()
            core = max(range(n), key=lambda i: (sums[i], -i))
            inside[0] = not core
            decide(core)
        self.cut = [(self.first[i], self.last[i]) for i in candidates if self.dropped[i] and not self.dropped[self.parent[i]]]

    def _read(self, source: str) -> None:
        stack, opened, at, break_ = [0], Counter(["body"]), 0, " "

        def text(raw: str) -> None:
            node = stack[-1]
            if raw and not self.dropped[node]:
                decoded = html.unescape(raw) if "&" in raw else raw
                self.pieces.append(decoded)
                self.own[node] += len("".join(decoded.split()))

        def close(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                opened[self.tag[node]] -= 1
                if self.tag[node] not in INLINE:
                    self.pieces.append(break_)
                self.last[node] = len(self.pieces)

        def depth_of(tags: tuple[str, ...], stops: frozenset[str]) -> int | None:
            for i in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[i]]
                if name in tags:
                    return i
                if name in stops:
                    return None
            return None

        markup, end_ = MARKUP, source.rfind(">")
        while at <= end_ and (m := markup.search(source, at)):
            text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if m[5]:
                markup = UNQUOTED
            if not name:
                continue
            if m[1] or m[4]:
                if opened[name] and name not in ("body", "html"):
                    blocks = CLOSES_P - {"p"} if name in INLINE else frozenset()
                    depth = depth_of((name,), blocks)
                    if depth is not None:
                        close(depth)
                continue
            if name in ("html", "body"):
                continue
            if name in CLOSES_P and opened["p"] and (d := depth_of(("p",), frozenset(("td", "th", "button", "object")))) is not None:
                close(d)
            if name in SIBLINGS and any(opened[t] for t in SIBLINGS[name]):
                while (d := depth_of(SIBLINGS[name], LISTS)) is not None:
                    close(d)
            if name not in INLINE:
                self.pieces.append(break_)
            if name in VOID:
                self.own.append(0)
                self._node(name, stack[-1], "", len(self.pieces))
                continue
            attributes = m[3] or m[6] or ""
            node = self._node(name, stack[-1], attributes, len(self.pieces))
            self.own.append(0)
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                if not self.dropped[node]:
                    self.pieces.append(html.unescape(source[at : end.start() if end else len(source)]))
                at = end.end() if end else len(source)
                self.last[node] = len(self.pieces)
                continue
            if not attributes.rstrip().endswith("/") or name not in ("svg", "path"):
                stack.append(node)
                opened[name] += 1
        text(UNENDED.sub("", source[at:]))
        close(0)

    def _node(self, tag: str, parent: int, attributes: str, at: int) -> int:
        within = self.article[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        doubt = GONE if self.dropped[parent] else self._apart(tag, attributes, within)
        self.dropped.append(doubt == GONE)
        self.doubt.append(FREE if doubt == GONE else doubt)
        self.article.append(within or tag in ("article", "main"))
        self.first.append(at)
        self.last.append(at)
        return len(self.tag) - 1

    def densities(self) -> tuple[list[float], list[float], list[int]]:
        """Composite density of each node, the sum over its children, and its characters."""
        n = len(self.tag)
        chars, tags, linked, links = list(self.own), [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(n):
            in_link[i] = self.tag[i] == "a" or (i > 0 and in_link[self.parent[i]])
            if in_link[i]:
                linked[i] = self.own[i]
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (self.tag[i] in ("a", "button", "select"))
        share = linked[0] / max(1, chars[0])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c = chars[i]
            if not c or self.dropped[i]:
                continue
            t, lc, lt = max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            base = math.log(c / max(1, c - linked[i]) * linked[i] + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / base)
            if i:
                sums[self.parent[i]] += density[i]
        return density, sums, chars

    def links(self) -> tuple[list[int], list[int]]:
        """Characters in links and number of links of each node."""
        n = len(self.tag)
        linked, links, in_link = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                linked[i] += self.own[i] * in_link[i]
                links[i] += self.tag[i] == "a"
                linked[self.parent[i]] += linked[i]
                links[self.parent[i]] += links[i]
        return linked, links

    def main_range(self) -> tuple[int, int]:
        """The run of pieces that is the article."""
        density, sums, chars = self.densities()
        if not chars[0]:
            return 0, 0
        core = max(range(len(sums)), key=lambda i: (sums[i], -i))
        if not sums[core]:
            core = 0
        path, on_path = [core], {core}
        while path[-1]:
            path.append(self.parent[path[-1]])
            on_path.add(path[-1])
        threshold = min(density[i] for i in path)
        # the core grows to the lowest run of the page that holds all dense parts
        low, high = self.first[core], self.last[core]
        beside = [i for i in range(1, len(density)) if self.parent[i] in on_path and i not in on_path and chars[i] and not self.dropped[i]]
        beside = [i for i in beside if self.parent[i] != core]
        for i in beside:
            if density[i] >= threshold:
                low, high = min(low, self.first[i]), max(high, self.last[i])
        holder = next((i for i in reversed(path) if self.tag[i] == "article"), None)
        if holder is None:
            holder = next((i for i in reversed(path) if self.tag[i] == "main"), None)
        if holder is not None:
            # headings and short blocks of the element around the core
            low, high = min(low, self.first[holder]), max(high, self.last[holder])
        else:
            for i in beside:
                if self.tag[i] in HEADINGS and self.last[i] <= low:
                    low = min(low, self.first[i])
                    break
        # lists of links in that run which the densities did not choose
        linked, links = self.links()
        self.cut += [(self.first[i], self.last[i]) for i in beside if density[i] < threshold and links[i] > 2 and 2 * linked[i] > chars[i]]
        self.cut.sort()
        return low, high


def extract(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    low, high = page.main_range()
    kept, at = [], low
    for start, end in page.cut:
        if low <= start and end <= high:
            kept += page.pieces[at:start]
            at = max(at, end)
    return " ".join("".join(kept + page.pieces[at:high]).split())


def main_text(source: Column) -> Column:
    """The main text of a column of HTML sources."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(extract, na_action=None)

    return of(source)


def extracted(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of the source; other columns pass through, columns named like
    a result are replaced."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (source, "text", "n_chars")]
    found = pages.select(*keep, main_text(F.col(source)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
