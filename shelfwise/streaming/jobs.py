"""The states of jobs, folded from their events in order: in a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A job's states and what each event makes of them.
MOVES = {("pending", "claim"): "generating", ("generating", "complete"): "completed", ("generating", "fail"): "failed", ("generating", "release"): "pending", ("failed", "retry"): "pending", ("generating", "unsupported"): "unsupported"}
DECIDED = "job long, event_id long, state string, claims long, applied boolean"
COLUMNS = [c.split()[0] for c in DECIDED.split(", ")]


def step(state: str, claims: int, name: str, claim: int) -> tuple[str, int, bool]:
    """State, number of claims and whether the event counted. A worker's word counts only under the claim in force: one whose lease was lost speaks of an older claim."""
    to = MOVES.get((state, name))
    if to is None or (state == "generating" and claim != claims):
        return state, claims, False
    return to, claims + (name == "claim"), True


def folded_jobs(events: DataFrame) -> DataFrame:
    """Decisions on all events (job, event_id, name, claim). One event at a time is held, so a job may have any number."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, state, claims = None, "pending", 0
        for batch in batches:
            out = []
            for own, event, name, claim in zip(batch["job"], batch["event_id"], batch["name"], batch["claim"], strict=True):
                if own != job:
                    job, state, claims = own, "pending", 0
                state, claims, applied = step(state, claims, name, claim)
                out.append((own, event, state, claims, applied))
            yield pd.DataFrame(out, columns=COLUMNS)

    ordered = events.select("job", "event_id", "name", "claim").repartition("job").sortWithinPartitions("job", "event_id")
    return ordered.mapInPandas(fold, DECIDED)


#: States that no event changes.
FINAL = frozenset(("completed", "unsupported"))


def folded_jobs_stream(events: DataFrame, keep: int) -> DataFrame:
    """The same over a stream with a watermark. The state of a job that is done goes keep ms after its last event, so that jobs that are done long since need no room; an event that comes later
    still would begin a new job of that name.

    events: job, event_id, name, claim, t (ms). A micro-batch's events of one job are put in order in memory; maxFilesPerTrigger or maxBytesPerTrigger of the source bounds them.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, claims, last = held.get if held.exists else ("pending", 0, 0)
        out = []
        for event, name, claim, t in sorted(row for b in batches for row in zip(b["event_id"], b["name"], b["claim"], b["t"], strict=True)):
            state, claims, applied = step(state, claims, name, claim)
            last = max(last, int(t))
            out.append((key[0], event, state, claims, applied))
        held.update((state, claims, last))
        if state in FINAL:
            held.setTimeoutTimestamp(max(last + keep, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=COLUMNS)

    return events.groupBy("job").applyInPandasWithState(fold, DECIDED, "state string, claims long, last long", "append", GroupStateTimeout.EventTimeTimeout)
