"""Leases of a job queue over event time: a job whose worker falls silent goes back when the watermark passes its lease, without an event of its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts and recoveries that a job has, and the first and the longest wait after a recovery.
MOST_ATTEMPTS, MOST_RECOVERIES, WAIT, LONGEST_WAIT = 3, 5, 60_000, 900_000
RECOVERED = "job long, at long, status string, error_code string, recoveries long, next_retry_at long"
COLUMNS = [c.split()[0] for c in RECOVERED.split(", ")]


class Job(NamedTuple):
    """A job's row; lease is the end of the lease in force, or -1."""

    status: str = "pending"
    lease: int = -1
    attempts: int = 0
    recoveries: int = 0
    retry_at: int = -1


STATE = "status string, lease long, attempts long, recoveries long, retry_at long"


def recovered(job: Job) -> tuple[Job, tuple]:
    """The job after its lease has run out, and (at, status, error, recoveries, retry at)."""
    spent, lame = job.attempts >= MOST_ATTEMPTS, job.recoveries + 1 >= MOST_RECOVERIES
    status, error = ("failed", "max_attempts") if spent else ("failed", "worker_recovery_exhausted") if lame else ("pending", "lease_expired")
    retry = job.lease + (0 if status == "failed" else min(WAIT << job.recoveries, LONGEST_WAIT))
    return Job(status, -1, job.attempts, job.recoveries + 1, retry), (job.lease, status, error, job.recoveries + 1, retry)


def stepped(job: Job, name: str, t: int, lease: int) -> Job:
    """A job after an event at t: claim (when it is due), begin (counts an attempt) and heartbeat (both renew the lease), complete, or enqueue, which begins anew."""
    if name == "claim" and job.status == "pending" and t >= job.retry_at:
        return job._replace(status="generating", lease=t + lease)
    if name == "enqueue" and job.status in ("completed", "failed"):
        return Job(retry_at=t)
    if job.status != "generating":
        return job
    if name == "complete":
        return job._replace(status="completed", lease=-1)
    if name == "heartbeat":
        return job._replace(lease=t + lease)
    if name == "begin" and job.attempts < MOST_ATTEMPTS:
        return job._replace(attempts=job.attempts + 1, lease=t + lease)
    return job


def played(job: Job, events: list[tuple[int, int, str]], lease: int) -> tuple[Job, list[tuple]]:
    """A job after events (t, number, name) in order, and the recoveries on the way: an event finds a lease that ended before it run out."""
    out = []
    for t, _, name in events:
        if job.status == "generating" and job.lease < t:
            job, said = recovered(job)
            out.append(said)
        job = stepped(job, name, t, lease)
    return job, out


def lapsed(events: DataFrame, lease: int) -> DataFrame:
    """All recoveries of events (job, t, event_id, name) up to the last event of all. One event at a time is held."""
    until = events.agg(F.max("t")).first()[0] or 0

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, job = None, Job()

        def ended() -> list[tuple]:
            return [(own, *recovered(job)[1])] if own is not None and job.status == "generating" and job.lease < until else []

        for batch in batches:
            out = []
            for key, t, event, name in zip(batch["job"], batch["t"], batch["event_id"], batch["name"], strict=True):
                if key != own:
                    out += ended()
                    own, job = key, Job()
                job, said = played(job, [(t, event, name)], lease)
                out += [(own, *s) for s in said]
            yield pd.DataFrame(out, columns=COLUMNS)
        yield pd.DataFrame(ended(), columns=COLUMNS)

    ordered = events.select("job", "t", "event_id", "name").repartition("job").sortWithinPartitions("job", "t", "event_id")
    return ordered.mapInPandas(fold, RECOVERED)


def lapsed_stream(events: DataFrame, lease: int) -> DataFrame:
    """The same over a stream with a watermark. A job's timer stands at the end of its lease. State is one row for each job of the queue.

    Events of a job come in the order of their times; a micro-batch's are put in order in memory.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        mark, out = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            job, out = played(job, sorted(row for b in batches for row in zip(b["t"], b["event_id"], b["name"], strict=True)), lease)
        if job.status == "generating" and (state.hasTimedOut or job.lease < mark):
            job, said = recovered(job)
            out.append(said)
        state.update(tuple(job))
        if job.status == "generating":
            state.setTimeoutTimestamp(max(job.lease, mark + 1))
        yield pd.DataFrame([(key[0], *s) for s in out], columns=COLUMNS)

    return events.groupBy("job").applyInPandasWithState(fold, RECOVERED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
