"""Chat formatting in budgeted windows.

Turns of a conversation stream in order through one task; only the turns of the open window are held. The
running sums of turn tokens choose turn-aligned spans: a window opens with the system turn, then repeats the
last turns of the window before as far as ``history`` tokens reach, then takes new turns while all of it
stays within ``budget``. A turn larger than the budget gets a window of its own.

The template writes ``<turn n=.. role=..>text</turn>``, with ``again`` on repeated turns. In texts and roles
a backslash becomes ``\\b``, ``<`` becomes ``\\l``, and in roles also ``>`` ``\\g`` and space ``\\s``; no raw
``<`` is left inside a text, so every control string is the template's own and escaping is reversible. The
loss mask covers the texts of assistant turns where they are new; repeated targets are masked out.

Conversations are dealt by id. Digests over all turns of a conversation are sequential by definition, so a
conversation passes through one task, with constant memory however long it is.

Defined results: null text or role is empty; null turn numbers come first; rows that tie on turn are ordered
by role and text, repeated rows are repeated turns; a null conversation id is one conversation; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.chunked import chunk_ids
from palimpsest.llm.common import shuffle_width, written

BUDGET = 1024
HISTORY = 256
TURN_COST = 16
TOKENIZER = "byte_bpe_50k.json"
TURN = re.compile(r"<turn n=(\d+) role=([^ >]*)( again)?>([^<]*)</turn>\n")
ESCAPED = {"b": "\\", "l": "<", "g": ">", "s": " "}


def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace(" ", "\\s")


def unescape(text: str) -> str:
    return re.sub(r"\\([blgs])", lambda m: ESCAPED[m[1]], text) if "\\" in text else text


class Windows:
    """Turns of one conversation in, finished windows out."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: list[tuple] = []
        self.carried: list[tuple] = []
        self.new: list[tuple] = []
        self.sums = [0]
        self.base = 0
        self.count = 0
        self.number = 0

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        """Take a turn; returns the window that it closes, if any."""
        turn = (self.count, role, text, tokens + TURN_COST)
        self.count += 1
        out = None
        if self.new and self.base + self.sums[-1] + turn[3] > self.budget:
            out = self.close()
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[3])
        return out

    def close(self) -> dict:
        parts, starts, ends, at = [], [], [], 0
        for again, turns in ((True, self.system), (True, self.carried), (False, self.new)):
            for n, role, text, _ in turns:
                head = f"<turn n={n} role={escape_role(role)}{' again' if again else ''}>"
                body = escape(text)
                if role == "assistant" and not again:
                    starts.append(at + len(head))
                    ends.append(at + len(head) + len(body))
                parts.append(f"{head}{body}</turn>\n")
                at += len(parts[-1])
        out = {"window": self.number, "formatted": "".join(parts), "loss_starts": starts, "loss_ends": ends}
        if not self.number:
            self.system = [t for t in self.new[:1] if t[1] == "system"]
        held = {t[0] for t in self.system}
        last = [t for t in (*self.carried, *self.new) if t[0] not in held]
        # the longest run of last turns within the history's tokens, by their running sums from the end
        keep, total = 0, 0
        while keep < len(last) and total + last[-1 - keep][3] <= self.history:
            total += last[-1 - keep][3]
            keep += 1
        self.carried = last[len(last) - keep :]
        self.base = total + sum(t[3] for t in self.system)
        self.new, self.sums = [], [0]
        self.number += 1
        return out


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER,
    key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Formatted windows: conv_id, window, formatted, loss_starts, loss_ends (code points of ``formatted``)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, None
        for batch in batches:
            out = []
            texts = [t or "" for t in batch["text"]]
            encoder = chunk_ids(tokenizer)
            width = 2 if encoder.dtype == "<u2" else 4
            tokens = [len(b) // width for b in encoder.encode(texts)]
            for conv, r, t, k in zip(batch["conv"], batch["role"], texts, tokens):
                if conv != now:
                    if open_ is not None:
                        out.append((now, open_.close()))
                    now, open_ = conv, Windows(budget, history)
                if (done := open_.add(r or "", t, k)) is not None:
                    out.append((conv, done))
            yield pd.DataFrame([{"conv": c, **w} for c, w in out], columns=["conv", "window", "formatted", "loss_starts", "loss_ends"])
        if open_ is not None:
            yield pd.DataFrame([{"conv": now, **open_.close()}])

    return (
        turns.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("conv"), F.col(order).alias("turn"),
            F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
        )
        .repartition(shuffle_width(turns.sparkSession), "conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .mapInPandas(of, "conv string, window int, formatted string, loss_starts array<int>, loss_ends array<int>")
        .select(F.when(F.col("conv") != "", F.col("conv")).cast(turns.schema[key].dataType).alias("conv_id"),
                "window", "formatted", "loss_starts", "loss_ends")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse windows again: the turns, without repetitions, and the text under the loss mask, as digests."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def row():
            return {
                "conv": now, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"],
                "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["all"],
            }

        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, text, starts, ends in zip(batch["conv"], batch["formatted"], batch["loss_starts"], batch["loss_ends"]):
                if conv != now:
                    if state is not None:
                        out.append(row())
                    now = conv
                    state = {"n": 0, "chars": 0, "all": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                state["all"] += len(text)
                for m in TURN.finditer(text):
                    if not m[3]:
                        state["n"] += 1
                        state["turns"].update(f"{unescape(m[2])}\n{unescape(m[4])}\n".encode())
                for a, b in zip(starts, ends):
                    part = unescape(text[a:b])
                    state["chars"] += len(part)
                    state["loss"].update(part.encode())
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([row()])

    return (
        formatted.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "window", "formatted", "loss_starts", "loss_ends")
        .repartition(shuffle_width(formatted.sparkSession), "conv").sortWithinPartitions("conv", "window")
        .mapInPandas(of, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
        .select(F.when(F.col("conv") != "", F.col("conv")).cast(formatted.schema["conv_id"].dataType).alias("conv_id"),
                "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    )


def formatted_conversations(turns: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the windows of all conversations and return what they read back as."""
    return read_back(written(windows(turns, **how), "chat-windows", path))
