"""Continuous ingest into a store, and newest versions kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", *, compact_every: int = 0, once: bool = False) -> StreamingQuery:
    """Append a stream of (key, op, value) to a store, a batch at a time.

    The manifest records the last batch of each stream in the snapshot that has its rows, so a batch that
    is run again after a failure changes nothing. The source's rate limit is the back-pressure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, stream=(name, batch_id))
        store.flush_if_full()
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact_all()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_aggregate(stream: DataFrame) -> DataFrame:
    """Newest version by key as a streaming aggregate, for complete or update mode; order of arrival is nothing."""
    return stream.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("newest")).select("key", "newest.*")


def latest_stateful(stream: DataFrame) -> DataFrame:
    """Newest version by key as custom state, in update mode: a key is emitted only when it has changed.

    A lower number than the state's is late and ignored, an equal one replaces it.
    """
    kind = {c: stream.schema[c].dataType.simpleString() for c in ("key", "value")}

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        before = held
        for part in rows:
            for seq, op, value in zip(part["seq"], part["op"], part["value"], strict=True):
                if held is None or seq >= held[0]:
                    held = (int(seq), int(op), value)
        if held is not None and held != before:
            state.update(held)
            yield pd.DataFrame({"key": [key[0]], "seq": [held[0]], "op": [held[1]], "value": [held[2]]})

    row = f"seq long, op int, value {kind['value']}"
    return stream.groupBy("key").applyInPandasWithState(fold, f"key {kind['key']}, {row}", row, "update", GroupStateTimeout.NoTimeout)
