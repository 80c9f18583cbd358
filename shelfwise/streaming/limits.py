"""Keyed state over events: the request limit, in a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "event_id long, key string, t long, allowed boolean, remaining long, retry_after long"


def consume(count: int, reset: int, t: int, limit: int, window: int) -> tuple[int, int, tuple[bool, int, int]]:
    """One request at t (ms): the state after it and (allowed, remaining, seconds to wait). A window begins with its first request; refused ones count too."""
    if t >= reset:
        count, reset = 0, t + window
    count += 1
    allowed = count <= limit
    return count, reset, (allowed, max(0, limit - count), 0 if allowed else max(1, -(-(reset - t) // 1000)))


def limited(events: DataFrame, limit: int, window: int) -> DataFrame:
    """Decisions for all events (event_id, key, t): each key's are folded in order of time, one row at a time, so a key may have any number."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, reset = None, 0, 0
        for batch in batches:
            out = []
            for event, own, t in zip(batch["event_id"], batch["key"], batch["t"], strict=True):
                if own != key:
                    key, count, reset = own, 0, 0
                count, reset, said = consume(count, reset, t, limit, window)
                out.append((event, own, t, *said))
            yield pd.DataFrame(out, columns=["event_id", "key", "t", "allowed", "remaining", "retry_after"])

    ordered = events.select("event_id", "key", "t").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return ordered.mapInPandas(fold, DECISION)


def limited_stream(events: DataFrame, limit: int, window: int) -> DataFrame:
    """The same over a stream with a watermark; the state of a key is its count and the end of its window, and goes when the watermark passes that end.

    Only keys with a window that is not over are kept. Events (event_id, key, t, at: the same time as a timestamp) that are later than the watermark allows are not
    decided on. A micro-batch's events of one key are put in order in memory; maxFilesPerTrigger or maxBytesPerTrigger of the source bounds them.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, 0)
        out = []
        for t, event in sorted(pair for b in batches for pair in zip(b["t"], b["event_id"], strict=True)):
            count, reset, said = consume(count, reset, int(t), limit, window)
            out.append((event, key[0], t, *said))
        if reset > state.getCurrentWatermarkMs():
            state.update((count, reset))
            state.setTimeoutTimestamp(reset)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "key", "t", "allowed", "remaining", "retry_after"])

    return events.groupBy("key").applyInPandasWithState(fold, DECISION, "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_value(column: str, order: str):
    """The last value of a group that is not null; an explicit null never resets one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
