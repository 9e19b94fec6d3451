"""Exact tokenization of long texts through a memo of whitespace-led chunks.

Both tokenizer files cut a text at the start of every whitespace run that follows a visible character, and
between a letter and a mark, whatever stands around it. A text is therefore cut there, each distinct chunk is
encoded once by the tokenizers library, and the results are joined. Texts with a character that libraries disagree on as
white space are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

SPACES = " \t\n\r\x0b\x0c\x85\xa0  -     　"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words and marks between plain white space, and a lone line end, stand apart in both vocabularies; what is
#: left runs from white space to white space.
CHUNK = re.compile(
    f" ?[{LATIN}]++(?=[.,;:!? \n]|\\Z)|[.,;:!?]++(?=[ \n]|\\Z)|\n(?=[^{SPACES}])|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+"
)
WORD = re.compile(f" ?[{LATIN}]+")
UNSURE = "᠎"
#: Chunks of a text with that character: cut only where white space begins whichever way it is read.
UNSURE_CHUNK = re.compile(f"[{SPACES}{UNSURE}]*[^{SPACES}{UNSURE}]+(?:{UNSURE}[{SPACES}{UNSURE}]*(?:[^{SPACES}{UNSURE}]+|\\Z))*|[{SPACES}{UNSURE}]+")
MEMO_ENTRIES = 600_000
ID_ENTRIES = 300_000
LATEST_ENTRIES = 100_000


def tokenizer_path(name_or_path: str) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def load_tokenizer(name_or_path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name_or_path))


SLICE_CHARS = 3_000_000


class Memo(dict):
    """Lasting entries, and behind them those of the texts at hand."""

    passing: dict = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.passing[chunk]


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``SLICE_CHARS`` characters, at least one text each; bounds the chunks at hand."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= SLICE_CHARS:
            yield some
            some, held = [], 0
    if some:
        yield some


def split_unseen(chunks: set[str], memo: Memo, entries: int = MEMO_ENTRIES) -> tuple[list[str], list[str]]:
    """(chunks for this slice only, chunks that the memo has room for: the shortest, which recur most)."""
    unseen = list(chunks.difference(memo))
    room = max(0, entries - len(memo))
    if not room:
        return unseen, []
    unseen.sort(key=len)
    return unseen[room:], unseen[:room]


class Recurring(dict):
    """Packed ids of chunks. A chunk is encoded when it is first asked for and held among the latest ones; asked for
    again there, it stays for good while there is room."""

    def __init__(self, encoded: Callable[[str], bytes]) -> None:
        self.encoded = encoded
        self.latest: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        latest = self.latest
        ids = latest.get(chunk)
        if ids is None:
            ids = self.encoded(chunk)
            if len(latest) >= LATEST_ENTRIES:
                latest.clear()
            latest[chunk] = ids
        elif len(self) < ID_ENTRIES:
            self[chunk] = latest.pop(chunk)
        return ids


class ChunkIds:
    """Token ids of whole texts as little-endian bytes, two bytes an id where the vocabulary allows it.

    The memo holds a bounded number of chunks, and one text is cut at a time.
    """

    def __init__(self, name_or_path: str) -> None:
        self.tokenizer = load_tokenizer(name_or_path)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = "<u2" if top < 65536 else "<u4"
        self.letters = self._letters()
        self.packed = [self.pack([i]) for i in range(top + 1)] if self.letters else []
        self.memo = Recurring(self._chunk)

    def _letters(self) -> dict[int, str] | None:
        """What the model reads for each character of a ``WORD``, if a word reaches it whole and nothing else is done to it."""
        before, special = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None or before is None or any(t.content == " " or WORD.fullmatch(t.content) for t in special):
            return None
        chars = "".join(c for c in map(chr, range(256)) if WORD.fullmatch(c))
        read = {c: before.pre_tokenize_str(c) for c in chars + " "}
        if any(len(found) != 1 for found in read.values()):
            return None
        table = {ord(c): found[0][0] for c, found in read.items()}
        for word in (chars, " " + chars):
            if [piece for piece, _ in before.pre_tokenize_str(word)] != [word.translate(table)]:
                return None
        return table

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk; a word goes straight to the tokenizer's model."""
        if self.letters and WORD.fullmatch(chunk):
            packed = self.packed
            return b"".join([packed[t.id] for t in self.tokenizer.model.tokenize(chunk.translate(self.letters))])
        return self.pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        last = b"" if end is None else self.pack([end])
        found = self.memo.__getitem__
        out = []
        for text in texts:
            if text and UNSURE not in text:
                out.append(b"".join(map(found, CHUNK.findall(text))) + last)
            else:
                out.append(self.pack(self.tokenizer.encode(text or "", add_special_tokens=False).ids) + last)
        return out


@lru_cache(maxsize=2)
def chunk_ids(name_or_path: str) -> ChunkIds:
    """The worker's encoder; it outlives a task, so its memo does too."""
    return ChunkIds(name_or_path)
