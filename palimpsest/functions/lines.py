"""Sentences, folded repeats and recall lines of whole texts in plain Python, for tasks that walk them.

``sentences`` gives what the Column expression ``functions.sentences.split_sentences`` gives, ``head_and_tail`` what
``sample_head_tail`` gives, ``cleaned_headers`` what ``functions.sanitize.neutralize_headers`` gives. Work on a text is
linear in its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from palimpsest import vocab as V

_E = V.SENTENCE_END
# A run and its optional terminator, or a lone terminator: no backtracking over long open texts.
PIECE = f"[^{_E}\n]+[{_E}]?|[{_E}]"
SENTENCE = f"[^{_E}]+[{_E}]?|[{_E}]"
SHORTEST_QUOTE = 6
LONGEST_QUOTE = 160
LEAD_SHARE = 0.75
_BEGUN = 40
_LONG = 60

_PIECES, _SENTENCES = re.compile(PIECE), re.compile(SENTENCE)
_SPACES = re.compile(f"[{V.WS}]+")
_LEAD = "#>-*" + V.WS
_MARK = re.compile(V.MARKER_PATTERN.replace("[WS]", f"[{V.WS}]"))
_FAKE_START = re.compile(f"^[{V.WS}]*{V.FAKE_HEADER_PREFIX}")


def bare_line(line: str) -> str:
    """Without leading list, heading and quote marks and bold marks."""
    return line.lstrip(_LEAD).replace("**", "").strip(V.WS)


def sentences(text: str | None) -> list[str]:
    joined = " ".join(p for p in map(bare_line, _PIECES.findall(text or "")) if p)
    return [s for s in (x.strip(V.WS) for x in _SENTENCES.findall(joined)) if s]


def collapsed(text: str) -> str:
    return _SPACES.sub(" ", text).strip(V.WS)


def one_unit(text: str) -> str:
    """A text that is one unit (8+ characters) said 2 to 12 times becomes that unit."""
    n = len(text)
    for times in range(2, 13) if n >= 24 else ():
        unit = n // times
        if n % times == 0 and unit >= 8 and text[unit:] == text[: n - unit]:
            return text[:unit]
    return text


def folded(text: str | None) -> str | None:
    """Sentences equal to their left neighbour dropped, then whole-text repeats folded."""
    found = sentences(text)
    if len(found) < 2:
        return text
    return one_unit(" ".join([found[0], *(b for a, b in zip(found, found[1:]) if a != b)]))


def head_and_tail(text: str, limit: int, share: float = LEAD_SHARE) -> str:
    """At most ``limit`` characters: the head, an ellipsis and the tail."""
    m, n = max(0, limit), len(text)
    if n <= m:
        return text
    if m <= 2:
        return "…"[:m]
    head = max(1, min(m - 2, math.floor((m - 1) * min(0.9, max(0.1, share)))))
    tail = max(1, m - 1 - head)
    return text[: m - 1] if n - tail <= head else f"{text[:head]}…{text[n - tail:]}"


def _has_fingerprint(text: str) -> bool:
    return any(f in text for f in V.HEADER_FINGERPRINTS)


def cleaned_headers(text: str) -> str:
    """Lines that imitate an injected header replaced, sentinels masked."""
    if _has_fingerprint(text) or _FAKE_START.match(text):
        text = "\n".join(
            V.HEADER_REMOVED if _has_fingerprint(x) else _FAKE_START.sub(V.FAKE_HEADER_REPLACEMENT, x) for x in text.split("\n")
        )
    return _MARK.sub(V.MARKER_REPLACEMENT, text)


def answers_and_body(lines: list[str]) -> tuple[list[str], list[str]]:
    """Of cleaned lines; a header opens an answer until the next one."""
    answers: list[list[str]] = []
    body: list[str] = []
    cur = ""
    for line in lines:
        asks = line.startswith("问：")
        inline = line.find("答：", 2) if asks else -1
        if inline >= 0:
            cur = "a"
            answers.append([line[inline + 2 :].strip(V.WS)])
        elif asks:
            cur = "q"
        elif line.startswith("答："):
            cur = "a"
            answers.append([line[2:].strip(V.WS)])
        elif cur == "a":
            answers[-1].append(line)
        else:
            body.append(line)
    return [a for a in map("\n".join, answers) if a], body


def _without_lead(found: list[str], lead: str) -> list[str]:
    """Sentences that the lead does not hold and that do not hold its beginning."""
    head = lead.strip(V.WS)
    if len(head) < SHORTEST_QUOTE:
        return found
    key = head[:_BEGUN]
    return [s for s in found if not (s in head or (len(key) >= _BEGUN and key in s))]


def _without_said(found: list[str], said: list[str]) -> list[str]:
    """Sentences that no said one covers: none begins with the sentence, the sentence begins with none's first
    40 characters and holds none of 60 characters or more."""
    if set(found) <= set(said):
        return []
    ordered = sorted({d for d in said if len(d) >= SHORTEST_QUOTE})
    begun = {d[:_BEGUN] for d in ordered}
    sizes = sorted({len(b) for b in begun})
    held: dict[str, list[str]] = {}
    for d in ordered:
        if len(d) >= _LONG:
            held.setdefault(d[:_LONG], []).append(d)

    def covered(s: str) -> bool:
        at = bisect_left(ordered, s)
        if at < len(ordered) and ordered[at].startswith(s) or any(s[:n] in begun for n in sizes):
            return True
        return bool(held) and any(
            s.startswith(d, i) for i in range(len(s) - _LONG + 1) for d in held.get(s[i : i + _LONG], ())
        )

    return [s for s in found if not covered(s)]


def _fitting(found: list[str], limit: int) -> tuple[int, int]:
    """How many leading sentences fit when joined by spaces, with their total length."""
    n = used = 0
    for s in found:
        cost = len(s) + (n > 0)
        if used + cost > limit:
            break
        n, used = n + 1, used + cost
    return n, used


def _ends(found: list[str], limit: int) -> str:
    """Whole sentences from both ends within ``limit`` characters, joined by an ellipsis."""
    whole = " ".join(found)
    if len(whole) <= limit:
        return whole
    if limit <= 2:
        return "…"[: max(0, limit)]
    head, used = _fitting(found, max(1, math.floor((limit - 1) * LEAD_SHARE)))
    tail, _ = _fitting(found[head:][::-1], limit - used - 1)
    if not (head or tail):
        return head_and_tail(whole, limit)
    return f"{' '.join(found[:head])}…{' '.join(found[len(found) - tail:])}"


def _packed(lead: str, optional: list[str], budget: int) -> str:
    """Lead, then optional parts while they fit; the first that does not is cut and ends it."""
    if not lead:
        return ""
    text, used = lead, len(lead)
    for part in filter(None, optional):
        room = budget - used - 3
        if len(part) > room:
            return f"{text} — {part[: room - 1]}…" if room >= SHORTEST_QUOTE else text
        text, used = f"{text} — {part}", used + 3 + len(part)
    return text


def _conclusions(source: str, emitted: list[str]) -> list[str]:
    bare = source.replace("**", "")
    if not any(m in bare for m in V.CONCLUSION_MARKERS):
        return []
    known = set(emitted)
    found = dict.fromkeys(
        s for s in sentences(source)
        if SHORTEST_QUOTE <= len(s) <= LONGEST_QUOTE and s.count("|") < 3 and "---" not in s
        and any(m in s for m in V.CONCLUSION_MARKERS) and s not in known
    )
    return list(found)[:2]


def line_of(title: str | None, text: str | None, limit: int) -> str:
    """One line for a block: title, lead, conclusions and a sample, at most ``limit`` characters."""
    title = cleaned_headers((title or "").strip(V.WS))
    raw = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    cleaned = [x for x in map(bare_line, cleaned_headers(raw).split("\n")) if x and x != title]
    answers, body = answers_and_body(cleaned)
    if not (body or answers):
        body = cleaned
    said = " ".join(answers)
    lead = folded(said if answers else body[0] if body else "")
    budget = limit - (len(title) + 3 if title else 0)
    if title and budget <= SHORTEST_QUOTE:
        return f"{title[: limit - 1]}…" if budget <= 0 else f"{title} — {head_and_tail(lead, budget)}"
    sample = folded(collapsed(" ".join(body) if body else said))
    cap = max(SHORTEST_QUOTE, math.ceil(budget * (0.8 if answers else LEAD_SHARE)))
    part = head_and_tail(lead, cap if budget > cap * 1.5 else budget) if lead else ""
    emitted = sentences(lead)
    quotes = _without_lead(_conclusions(said if answers else raw, emitted), part)
    rest = _without_lead(_without_said(sentences(said if answers else sample), emitted + quotes), part)
    tail = _ends(rest, max(SHORTEST_QUOTE, math.ceil(budget * (1 - LEAD_SHARE)), budget - len(part) - 3))
    if not (tail or quotes) and len(lead) > len(part):
        part = head_and_tail(lead, budget)
    shown = _packed(part, [*quotes, tail], budget) or head_and_tail(lead or sample, budget).strip(V.WS)
    line = collapsed(" — ".join(filter(None, (title, shown))))
    return line if len(line) <= limit else f"{line[: limit - 1]}…"
