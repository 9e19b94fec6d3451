"""Exact token counts at every prefix of a text.

``prefix_counts`` stores, for every code point, how the token count changes when the text is cut after it;
running sums of that array are the counts of all prefixes. ``tokens_before``, ``longest_prefix`` and
``fits`` answer truncation and budget questions from the stored array; nothing is encoded again.

Inside a word the counts come from dynamic programming over its prefixes: an encoding by ranked merges
extends the encoding of a shorter prefix by one token exactly if the last two tokens stay apart when they
are merged alone, so each prefix keeps its last token and its count. States are shared by all words with
the same beginning.

Defined results: a null text counts as empty (0 tokens, empty array). White space adds nothing. Special
strings inside a text count as the library counts them. Texts that are not in normal form C are counted by
encoding each prefix of the one affected chunk.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from palimpsest.llm.chunked import CHUNK, SPACES, UNSURE, UNSURE_CHUNK, Memo, load_tokenizer, slices, split_unseen, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
PAIR_ENTRIES = 400_000
STATE_ENTRIES = 800_000


def byte_letters() -> list[str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Counts tokens at every prefix; one per Python worker."""

    def __init__(self, name_or_path: str = TOKENIZER) -> None:
        import re

        import regex

        self.tokenizer = load_tokenizer(name_or_path)
        with open(tokenizer_path(name_or_path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = set(model["vocab"])
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo = Memo()
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # prefix -> (last token, open count, closed count, closed counts of all its prefixes)
        self.states: dict[str, tuple[str, int, int, bytes]] = {}
        self.beyond = re.compile("<\\||[^\\x00-\xd6\xd8-\xf6\xf8-\xff]")
        # what the vocabulary's own normalizer folds; a run becomes one space
        self.fold = re.compile(f"[{SPACES}{UNSURE if len(self.tokenizer.normalizer.normalize_str(f'a{UNSURE} a')) == 3 else ''}]+")
        # a run of Latin letters with marks behind it: two pieces, whatever stands around them
        self.simple = re.compile(f"([{SPACES}]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            left, right = symbols[ranks.index(best)], symbols[ranks.index(best) + 1]
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def stands(self, token: str) -> bool:
        """Does the token survive as one when its own letters are merged?"""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.symbols(token)) == [token]
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= PAIR_ENTRIES:
                self.apart.clear()
            known = self.apart[pair] = self.merge([*self.symbols(left), *self.symbols(right)]) == [left, right]
        return known

    def extend(self, word: str, i: int, state: Callable[[int], tuple]) -> tuple[str, int, int]:
        """(last token of the open prefix, its count, count of the prefix as a finished word).

        ``state`` gives what earlier prefixes of the word have.
        """
        last, opened, closed = "", 0, 0
        vocab = self.vocab
        for size in range(1, min(i, self.longest) + 1):
            token = word[i - size : i]
            end = token + self.suffix
            open_ = not opened and token in vocab
            close = not closed and end in vocab
            if not (open_ or close):
                continue
            if size == i:
                if open_ and self.stands(token):
                    last, opened = token, 1
                if close and self.stands(end):
                    closed = 1
                break
            before = state(i - size)
            if before[1]:
                if open_ and self.stay_apart(before[0], token):
                    last, opened = token, before[1] + 1
                if close and self.stay_apart(before[0], end):
                    closed = before[1] + 1
                if opened and closed:
                    break
        return last, opened, closed

    def word_counts(self, word: str) -> Sequence[int]:
        """Counts of all prefixes of one piece, given in the vocabulary's byte letters.

        Pieces of usual length keep the state of each prefix, with the counts so far, for words that begin
        alike; the computation starts at the longest known prefix.
        """
        if len(word) > 40:
            rows: list[tuple[str, int, int]] = [("", 0, 0)]
            for i in range(1, len(word) + 1):
                rows.append(self.extend(word, i, rows.__getitem__))
            return [r[2] for r in rows[1:]]
        states = self.states
        if len(states) >= STATE_ENTRIES:
            states.clear()
        i = len(word)
        while i and word[:i] not in states:
            i -= 1
        counts = states[word[:i]][3] if i else b""
        for k in range(i + 1, len(word) + 1):
            last, opened, closed = self.extend(word, k, lambda j: states[word[:j]])
            counts += bytes((closed,))
            states[word[:k]] = last, opened, closed, counts
        return counts

    def piece(self, text: str) -> Sequence[int]:
        """Counts at each code point of one normalized piece."""
        if text.isascii():
            return self.word_counts("".join([self.letters[b] for b in text.encode()]) if not text.isprintable() else text)
        counts = self.word_counts("".join([self.letters[b] for b in text.encode()]))
        out, at = [], 0
        for ch in text:
            at += len(ch.encode())
            out.append(counts[at - 1])
        return out

    def chunk(self, chunk: str) -> list[int]:
        """Counts of all prefixes of one chunk, one per code point."""
        if m := self.simple.fullmatch(chunk):
            space, core, tail = m.groups()
            counts = [0] * len(space) + list(self.piece(core.lower()))
            if tail:
                counts += [counts[-1] + n for n in self.piece(tail)]
            return counts
        if not self.beyond.search(chunk):
            # one code point stays one code point, in composed form
            counts, done = [0] * len(chunk), 0
            for piece, (lo, hi) in self._pieces(chunk.lower()):
                counts[lo:hi] = [done + n for n in self.piece(piece)]
                done = counts[hi - 1]
            return counts
        plain = unicodedata.is_normalized("NFC", chunk) and not any(s in chunk for s in self.special)
        if not plain:
            some = [chunk[: i + 1] for i in range(len(chunk))]
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        # normalization lowers each code point alone; a code point may become several
        sizes = [len(self.tokenizer.normalizer.normalize_str(ch)) for ch in chunk]
        norm = self.tokenizer.normalizer.normalize_str(chunk)
        for run in self.fold.finditer(chunk):
            sizes[run.start() : run.end()] = [1] + [0] * (len(run.group()) - 1)
        at = np.zeros(len(norm) + 1, np.int64)
        done = 0
        for piece, (lo, hi) in self._pieces(norm):
            counts = self.piece(piece)
            at[lo + 1 : hi + 1] = done + np.array(list(counts))
            done += counts[-1]
            at[hi + 1 :] = done
        return at[np.cumsum(sizes)].tolist()

    def _pieces(self, norm: str) -> Iterator[tuple[str, tuple[int, int]]]:
        """The pieces of a normalized chunk with their places; white space belongs to none."""
        return ((m.group(), m.span()) for m in self.pattern.finditer(norm))

    def plain(self, text: str) -> str:
        """Fewer distinct chunks: lower case and spaces for line ends, where that keeps every count."""
        if self.beyond.search(text):
            return text
        return text.lower().replace("\n", " ")

    def _remember(self, chunk: str, memo: dict[str, bytes]) -> None:
        counts = self.chunk(chunk)
        steps = [n - m for m, n in zip([0, *counts], counts)]
        if steps and (max(steps) > 127 or min(steps) < -128):
            raise OverflowError("one code point changes the count by more than a byte holds")
        memo[chunk] = bytes([n & 255 for n in steps])

    def steps(self, texts: list[str | None]) -> list[bytes]:
        """For each text one signed byte per code point: the change of the token count."""
        return [stored for some in slices(texts) for stored in self._steps(some)]

    def _steps(self, texts: list[str | None]) -> list[bytes]:
        cut = [CHUNK.findall(self.plain(t)) if t and UNSURE not in t else UNSURE_CHUNK.findall(t or "") for t in texts]
        passing, lasting = split_unseen(set().union(*cut), memo := self.memo)
        for chunk in lasting:
            self._remember(chunk, memo)
        memo.passing = {}
        for chunk in passing:
            self._remember(chunk, memo.passing)
        return [b"".join(map(memo.__getitem__, chunks)) for chunks in cut]


@lru_cache(maxsize=2)
def counter(name_or_path: str) -> PrefixCounter:
    """The worker's counter; it outlives a task, so its memo does too."""
    return PrefixCounter(name_or_path)


def tokens_before(steps: bytes, end: int | None = None) -> int:
    """Tokens of the prefix of ``end`` code points (all without one)."""
    return int(np.frombuffer(steps, np.int8, count=-1 if end is None else min(end, len(steps))).sum(dtype=np.int64))


def longest_prefix(steps: bytes, limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    good = np.flatnonzero(counts <= limit)
    return int(good[-1]) + 1 if good.size else 0


def prefix_counts(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """The stored array of a text: binary, one signed byte per code point."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter(tokenizer).steps(texts.tolist()), dtype=object)

    return of(text)


def answers(steps: Column, limit: int) -> Column:
    """struct(n_tokens, over_limit, cut_chars) from stored arrays: the count of the whole text, whether it
    is over ``limit``, and the longest prefix within it."""

    @F.pandas_udf("n_tokens long, over_limit boolean, cut_chars long")
    def of(stored: pd.Series) -> pd.DataFrame:
        n = [tokens_before(s or b"") for s in stored]
        cut = [len(s or b"") if k <= limit else longest_prefix(s, limit) for s, k in zip(stored, n)]
        return pd.DataFrame({"n_tokens": n, "over_limit": [k > limit for k in n], "cut_chars": cut})

    return of(steps)


def token_counts(docs: DataFrame, limit: int, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens, over_limit and cut_chars.

    Rows are independent: repeated rows give repeated results, other columns pass through untouched, a column
    named like a result is replaced. The stored arrays live for a slice of texts only.
    """
    results = ["n_bytes", "n_tokens", "over_limit", "cut_chars"]
    keep = [c for c in docs.columns if c not in (text, *results)]
    spare = "_" * (1 + max((len(c) for c in keep), default=0))  # a name that no column has

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            n, cut = [], []
            for some in slices(texts):
                for steps in counter(tokenizer).steps(some):
                    n.append(tokens_before(steps))
                    cut.append(len(steps) if n[-1] <= limit else longest_prefix(steps, limit))
            size = [len(t.encode()) if t else 0 for t in texts]
            made = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(cut, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=[*batch.schema.names[: len(keep)], *results])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias(spare))
    schema = StructType([*[docs.schema[c] for c in keep], *[StructField(c, BooleanType() if c == "over_limit" else LongType()) for c in results]])
    return rows.mapInArrow(of, schema)
