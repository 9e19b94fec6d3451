"""Per-key state: rate limits and what a session is currently showing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.ordered import last_before, running_sum
from palimpsest.session import spread

WINDOW_MS = 60_000
MAX_CALLS = 6
REMEMBERED = 40


def _admit(stamps: list[int], at: int, window: int, most: int) -> tuple[list[int], bool, int]:
    """Stamps still counted, whether ``at`` is admitted, and how long to wait otherwise."""
    live = [s for s in stamps if s > at - window]
    if len(live) >= most:
        return live, False, max(0, live[0] + window - at)
    return [*live, at], True, 0


def rate_limited(calls: DataFrame, window_ms: int = WINDOW_MS, most: int = MAX_CALLS) -> DataFrame:
    """Batch limiter over ``key, n, at_ms``: adds allowed and retry_after_ms.

    ``n`` orders a key's calls in time. Refused calls are not counted, so this is sequential; but
    a pause of a whole window forgets everything. Calls are split at such pauses, sorted, and
    streamed through with a handful of stamps in memory.
    """
    seen = last_before(calls, ["key"], "n", F.col("at_ms"), "_before")
    pause = F.coalesce(F.col("at_ms") - F.col("_before") >= window_ms, F.lit(True))
    split = running_sum(seen, ["key"], "n", pause.cast("bigint"), "_run").drop("_before")
    ordered = spread(split, "key", "_run").sortWithinPartitions("key", "_run", "n")

    def limit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stamps = None, []
        for pdf in batches:
            allowed, retry = [], []
            for key, run, at in zip(pdf["key"], pdf["_run"], pdf["at_ms"]):
                if (key, run) != current:
                    current, stamps = (key, run), []
                stamps, ok, wait = _admit(stamps, int(at), window_ms, most)
                allowed.append(ok)
                retry.append(wait)
            yield pdf[["key", "n", "at_ms"]].assign(allowed=allowed, retry_after_ms=retry)

    kind = dict(calls.dtypes)["key"]
    return ordered.mapInPandas(
        limit, f"key {kind}, n bigint, at_ms bigint, allowed boolean, retry_after_ms bigint"
    )


def rate_limited_stream(
    calls: DataFrame, window_ms: int = WINDOW_MS, most: int = MAX_CALLS
) -> DataFrame:
    """Streaming limiter over ``key string, at_ms bigint``; state is at most ``most`` stamps."""

    def limit(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps = list(state.get[0]) if state.exists else []
        out = []
        times = sorted(int(t) for pdf in batches for t in pdf["at_ms"])
        for at in times:
            stamps, ok, wait = _admit(stamps, at, window_ms, most)
            out.append((key[0], at, ok, wait))
        state.update((stamps,))
        yield pd.DataFrame(out, columns=["key", "at_ms", "allowed", "retry_after_ms"])

    return calls.groupBy("key").applyInPandasWithState(
        limit, "key string, at_ms bigint, allowed boolean, retry_after_ms bigint",
        "stamps array<bigint>", "append", GroupStateTimeout.NoTimeout,
    )


_SHOWN = "session string, seq bigint, action string, text string"
_STATE = (
    "pending_seq bigint, pending_text string, sticky string, boost string, boost_seen boolean, "
    "fps array<string>, done_seq bigint"
)


def session_view(events: DataFrame) -> DataFrame:
    """What each session shows after every event.

    ``events``: session, seq, type, text, fp. Types: inbox (an early copy of a question; the same
    text keeps its first seq), question, recall (the block found for a question; a seq is
    answered once), boost (queued material, shown in full turns until the end of a turn that
    showed it), turn/end, compaction/end (forgets the sticky block). Up to 40 shown fingerprints
    are remembered.
    """

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [-1, "", "", "", False, [], -1]
        pending_seq, pending, sticky, boost, boost_seen, fps, done = s
        fps, out = list(fps), []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for r in rows.itertuples(index=False):
            action, text = r.type, ""
            if r.type in ("inbox", "question"):
                if pending != r.text:
                    pending_seq, pending = int(r.seq), r.text
                action, text = f"ask@{pending_seq}", pending
            elif r.type == "recall":
                if pending_seq == done:
                    action = "memo"
                elif r.fp and r.fp in fps:
                    action = "repeat"
                elif r.text:
                    sticky = r.text
                    fps = [*fps, r.fp][-REMEMBERED:] if r.fp else fps
                done = pending_seq
                text = "\n\n".join(x for x in (sticky, boost) if x)
                boost_seen = boost_seen or boost != ""
            elif r.type == "boost":
                boost, boost_seen = r.text, False
            elif r.type == "turn/end" and boost_seen:
                boost, boost_seen = "", False
            elif r.type == "compaction/end":
                sticky = ""
            out.append((key[0], int(r.seq), action, text))
        state.update((pending_seq, pending, sticky, boost, boost_seen, fps, done))
        yield pd.DataFrame(out, columns=["session", "seq", "action", "text"])

    return events.groupBy("session").applyInPandasWithState(
        advance, _SHOWN, _STATE, "append", GroupStateTimeout.NoTimeout
    )
