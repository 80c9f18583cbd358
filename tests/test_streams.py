import random

from shelfwise.plans.streams import indexed, job_states, job_states_stream, request_limit, request_limit_stream
from shelfwise.sources.catalog import Library
from shelfwise.streaming.jobs import folded_jobs, step
from shelfwise.streaming.limits import limited

SMALL = "/root/testdata/sf0.001"


def brute(rows, limit, window):
    state, out = {}, {}
    for event, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        count, reset = state.get(key, (0, 0))
        if t >= reset:
            count, reset = 0, t + window
        state[key] = (count + 1, reset)
        out[event] = count + 1 <= limit
    return out


def test_limit(spark):
    rng = random.Random(2)
    rows = [(i, f"k{rng.randint(0, 4)}", rng.randint(1, 10**6)) for i in range(3000)]
    got = {r["event_id"]: r["allowed"] for r in limited(spark.createDataFrame(rows, "event_id long, key string, t long"), 3, 60_000).collect()}
    assert got == brute(rows, 3, 60_000)
    one = limited(spark.createDataFrame([(1, "a", 10_000), (2, "a", 30_000), (3, "a", 70_000)], "event_id long, key string, t long"), 1, 60_000).orderBy("t").collect()
    assert [(r["allowed"], r["retry_after"]) for r in one] == [(True, 0), (False, 40), (True, 0)]


def test_stream_equals_batch(spark):
    lib = Library(spark, SMALL)
    rows = lambda df: {(r["event_id"], r["allowed"], r["remaining"]) for r in df.collect()}
    assert rows(request_limit_stream(lib)) == rows(request_limit(lib))


def test_states(spark):
    """A worker that lost its lease cannot finish the job of the next one."""
    events = [("claim", 0), ("release", 1), ("claim", 0), ("complete", 1), ("fail", 2), ("complete", 2), ("retry", 2), ("claim", 2)]
    rows = spark.createDataFrame([(7, i, n, c) for i, (n, c) in enumerate(events)] + [(8, 0, "complete", 0)], "job long, event_id long, name string, claim long")
    got = [(r["state"], r["claims"], r["applied"]) for r in folded_jobs(rows).orderBy("job", "event_id").collect()]
    assert got == [("generating", 1, True), ("pending", 1, True), ("generating", 2, True), ("generating", 2, False), ("failed", 2, True), ("failed", 2, False), ("pending", 2, True), ("generating", 3, True), ("pending", 0, False)]
    assert step("completed", 3, "claim", 0) == ("completed", 3, False)


def test_states_stream_equals_batch(spark):
    lib = Library(spark, SMALL)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(job_states_stream(lib)) == rows(job_states(lib))


def test_index_goes_on_after_a_gap(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 10, 20), (1, 40, 50), (1, 45, 48), (1, 50, 60), (2, 5, 9)]
    got = {r["stream"]: (r["fragments"], r["gaps"], r["frontier"]) for r in indexed(spark.createDataFrame(rows, "stream long, first_byte long, end_byte long")).collect()}
    assert got == {1: (4, 1, 60), 2: (1, 0, 9)}


def test_recovered_syncs(spark):
    from pyspark.sql import functions as F

    from shelfwise.plans.jobs import recovered_syncs

    rows = [(1, "SYNCING", 0), (2, "SYNCED", 5), (3, "SYNCING", 2), (4, "ERROR", 1)]
    got = recovered_syncs(spark.createDataFrame(rows, "id int, status string, failures int"), F.lit(None).cast("timestamp_ntz")).orderBy("id").collect()
    assert [(r["id"], r["status"], r["failures"], r["outcome"]) for r in got] == [(1, "ERROR", 1, "interrupted"), (3, "ERROR", 3, "interrupted")]


def test_applied_plan(spark):
    from shelfwise.operators.reconcile import plan_changes
    from shelfwise.plans.sync import applied_rows

    side = "node_id string, name string, size long, ts long, parent string, fa string"
    remote = spark.createDataFrame([("a", "Jane - New.mkv", 5, 1, None, "1:0*t"), ("b", None, 7, 1, None, None), ("c", "Same.mp4", 5, 1, "p", "1:0*t"), ("d", None, 9, 1, None, "1:0*t"), ("f", "Bob - Renamed", 5, 1, "p", "1:0*t")], side)
    existing = spark.createDataFrame([(3, "c", "Same.mp4", 5, 1, "p", "1:0*t"), (4, "d", "Kept.webm", 5, 1, None, "1:0*t"), (5, "e", "Gone.mp4", 5, 1, None, None), (6, "f", "Old.mov", 5, 1, "p", "1:0*t")], "id long, " + side)
    got = {r["node_id"]: tuple(r)[1:] for r in applied_rows(plan_changes(remote, existing)).collect()}
    assert got == {
        "a": (None, "Jane - New.mkv", "New", "Jane", "video/x-matroska", 5, None, True), "b": (None, "video-b", "video-b", "Unknown Creator", None, 7, None, False), "c": (3, "Same.mp4", "Same", "Unknown Creator", "video/mp4", 5, "p", True),
        "d": (4, "Kept.webm", "Kept", "Unknown Creator", "video/webm", 9, None, True), "f": (6, "Bob - Renamed", "Renamed", "Bob", "video/quicktime", 5, "p", True),
    }
