"""Incremental ingest: a stream of compactions or blocks becomes stored records once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.records import finish_records
from palimpsest.sources.store import BlockStore


def ingest_blocks(
    blocks: DataFrame,
    store: BlockStore,
    checkpoint: str,
    *,
    finish: Callable[[DataFrame], DataFrame] = finish_records,
) -> StreamingQuery:
    """Finish each micro-batch of blocks and append what the store does not hold yet.

    The anti-join on fingerprints makes a replayed batch a no-op, so a restart after a lost
    driver neither drops nor doubles records.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(finish(batch))

    return (
        blocks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
