"""Streams over several micro-batches: carried state, timers, expiring state, upserts."""

import random
import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfwise.sources.keyed import KeyedFiles
from shelfwise.streaming import fragments as X
from shelfwise.streaming import leases as L
from shelfwise.streaming.feeds import laid_down, place, run_to_end, stream_of
from shelfwise.streaming.limits import limited, limited_stream
from shelfwise.streaming.progress import read_progress, status_changes_stream, trailing_stream, write_progress


def whole(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def movie(n, *tracks, long=True):
    runs = [whole(b"traf", whole(b"tfhd", struct.pack(">II", 0, t)), whole(b"tfdt", struct.pack(">IQ", 1 << 24, base) if long else struct.pack(">II", 0, base))) for t, base in tracks]
    return whole(b"moof", whole(b"mfhd", struct.pack(">II", 0, n)), *runs)


SCALES, VIDEO = {1: 1000, 2: 48_000}, 1


def found(chunks):
    """The index of one stream from (place, bytes) in order, by the library's own steps."""
    offset, pending, out = 0, b"", []
    for at, data in chunks:
        offset, pending = X.taken_in(offset, pending, data, at)
        more, offset, pending = X.advanced(offset, pending, SCALES, VIDEO)
        out += more
    return out


@pytest.fixture(scope="module")
def film():
    rng = random.Random(4)
    data, want = whole(b"ftyp", b"isom"), []
    for n in range(1, 40):
        extra = rng.choice([b"", whole(b"free", bytes(rng.randrange(30))), whole(b"sidx", b"x" * 9)])
        data += extra
        tracks = rng.choice([[(1, n * 500)], [(2, n * 24_000)], [(2, n * 24_000 - 48), (1, n * 500)], [(9, 1)]])
        box = movie(n, *tracks, long=n % 2 == 0)
        media = whole(b"mdat", rng.randbytes(rng.randrange(200)))
        if tracks != [(9, 1)]:
            want.append((n / 2, len(data), len(data) + len(box) + len(media), n))
        data += box + media
    return data, want


def cut(data, rng, most=90):
    places = sorted({0, *(rng.randrange(len(data)) for _ in range(len(data) * 2 // most))})
    return [(a, data[a:b]) for a, b in zip(places, [*places[1:], len(data)], strict=True)]


def test_pieces_give_the_index_of_the_whole(film):
    data, want = film
    assert found([(0, data)]) == want
    for seed in range(20):
        rng = random.Random(seed)
        chunks = cut(data, rng, rng.choice([3, 50, 400]))
        longer = [(max(0, a - rng.randrange(20)), a, d) for a, d in chunks]  # some bytes once more
        chunks = [(a, data[a : b + len(d)]) for a, b, d in longer]
        assert found([c for c in chunks for _ in range(rng.randrange(1, 3))]) == want


def test_a_gap_begins_anew():
    first, second = movie(1, (1, 0)) + whole(b"mdat", b"abc"), movie(2, (1, 500)) + whole(b"mdat", b"de")
    got = found([(0, first[:30]), (len(first), second)])
    assert got == [(0.5, len(first), len(first) + len(second), 2)]


def test_boxes_of_other_sizes():
    assert X.box(struct.pack(">I4sQ", 1, b"mdat", 20) + bytes(4), 0) == (20, b"mdat") and X.box(struct.pack(">I4sQ", 1, b"mdat", 8), 0) is None and X.box(struct.pack(">I4s", 1, b"mdat"), 0) is None
    assert X.box(struct.pack(">I4s", 0, b"free") + bytes(5), 0) == (13, b"free") and X.box(struct.pack(">I4s", 7, b"free"), 0) is None and X.box(b"1234567", 0) is None
    assert found([(0, movie(1, (1, 9)) + whole(b"free") + movie(2, (1, 500)) + whole(b"mdat"))])[0][3] == 2  # a fragment without media is none
    assert found([(0, movie(1) + whole(b"mdat") + movie(3, (2, 48_000)) + whole(b"mdat"))])[0][0] == 1.0


def test_fragment_stream(spark, film):
    """Three micro-batches at least; a state goes with the last piece."""
    data, want = film
    rows = [(s, a, bytearray(d), a + len(d) == len(data) and s != 2) for s in range(4) for a, d in cut(data, random.Random(s))]
    table = spark.createDataFrame(rows, "stream long, first_byte long, data binary, last boolean")
    third = len(data) // 3
    path = laid_down(table, "stream", [F.col("first_byte") < third, F.col("first_byte").between(third, 2 * third - 1), F.col("first_byte") >= 2 * third], "pieces")
    out, ended = run_to_end(X.indexed_stream(stream_of(spark, path, table.schema, 1), SCALES, VIDEO), "pieces")
    got = sorted(map(tuple, out.collect()))
    assert got == [(s, i, *w) for s in range(4) for i, w in enumerate(want)]
    steps = [p for p in ended.recentProgress if p["numInputRows"]]
    assert len(steps) >= 3 and max(p["stateOperators"][0]["numRowsTotal"] for p in ended.recentProgress) <= 4 and ended.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def stamp(ms):
    return datetime(2026, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None) + timedelta(milliseconds=ms)


def timed(spark, rows, schema, parts=4):
    """rows (t in ms first in the schema's t) as a stream of so many micro-batches in the order of t, with a watermark on at."""
    base = int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    table = spark.createDataFrame(rows, schema).withColumn("t", F.col("t") + base).withColumn("at", F.timestamp_millis("t"))
    most = table.agg(F.max("t")).first()[0] - base
    bounds = [most * k // parts for k in range(parts)] + [most + 1]
    key = "key" if "key" in table.columns else "job"
    path = laid_down(table, key, [(F.col("t") - base >= a) & (F.col("t") - base < b) for a, b in zip(bounds, bounds[1:], strict=False)], "timed")
    return table, stream_of(spark, path, table.schema, 1).withWatermark("at", "0 seconds"), base


def test_windows_that_are_over_leave_the_state(spark):
    """Each key asks in one minute of its own: only keys of the last windows may be kept."""
    rows = [(k * 10 + i, f"k{k}", k * 60_000 + i * 1000) for k in range(60) for i in range(5)]
    table, stream, _ = timed(spark, rows, "event_id long, key string, t long", 6)
    out, ended = run_to_end(limited_stream(stream, 3, 60_000), "limit")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in limited(table, 3, 60_000).collect()}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in ended.recentProgress]
    assert max(kept) <= 22 and kept[-1] <= 2, kept


def brute_leases(rows, lease):
    out, end = [], max(t for _, _, _, t in rows)
    for job in {r[0] for r in rows}:
        state = {"status": "pending", "lease": None, "attempts": 0, "recoveries": 0, "retry": -1}

        def lapse(now, job=job):
            if state["status"] == "generating" and state["lease"] < now:
                at, final = state["lease"], state["attempts"] >= 3 or state["recoveries"] + 1 >= 5
                error = "max_attempts" if state["attempts"] >= 3 else "worker_recovery_exhausted" if final else "lease_expired"
                state.update(status="failed" if final else "pending", retry=at + (0 if final else min(60_000 * 2 ** state["recoveries"], 900_000)), recoveries=state["recoveries"] + 1)
                out.append((job, at, state["status"], error, state["recoveries"], state["retry"]))

        for _, _, name, t in sorted((r for r in rows if r[0] == job), key=lambda r: (r[3], r[1])):
            lapse(t)
            busy = state["status"] == "generating"
            if name == "claim" and state["status"] == "pending" and t >= state["retry"]:
                state.update(status="generating", lease=t + lease)
            elif name == "enqueue" and state["status"] in ("completed", "failed"):
                state.update(status="pending", attempts=0, recoveries=0, retry=t)
            elif name == "complete" and busy:
                state.update(status="completed")
            elif name == "heartbeat" and busy:
                state.update(lease=t + lease)
            elif name == "begin" and busy and state["attempts"] < 3:
                state.update(attempts=state["attempts"] + 1, lease=t + lease)
        lapse(end)
    return sorted(out)


def test_leases_lapse_by_timers(spark):
    rng = random.Random(8)
    rows = [(j := rng.randrange(12), e, rng.choice([*["claim"] * 7, "begin", "heartbeat", "complete", "enqueue"] if j % 2 else [*["claim"] * 3, "begin", "complete", "enqueue"]), rng.randrange(40_000_000)) for e in range(900)]
    table, stream, base = timed(spark, rows, "job long, event_id long, name string, t long", 5)
    want = [(j, at + base, s, e, n, r + base) for j, at, s, e, n, r in brute_leases(rows, 900_000)]
    assert {e for *_, e, _, _ in want} == {"max_attempts", "worker_recovery_exhausted", "lease_expired"} and len(want) > 100
    assert sorted(map(tuple, L.lapsed(table, 900_000).collect())) == want
    out, ended = run_to_end(L.lapsed_stream(stream, 900_000), "leases")
    assert sorted(map(tuple, out.collect())) == want
    assert ended.lastProgress["stateOperators"][0]["numRowsTotal"] == 12


def test_a_silent_job_goes_back_without_an_event(spark):
    rows = [(1, 0, "claim", 0), (2, 1, "claim", 5_000_000)]
    _, stream, base = timed(spark, rows, "job long, event_id long, name string, t long", 2)
    out, _ = run_to_end(L.lapsed_stream(stream, 1_000_000), "silent")
    assert [tuple(r) for r in out.collect()] == [(1, base + 1_000_000, "pending", "lease_expired", 1, base + 1_060_000)]


def test_only_touched_buckets_are_written(spark):
    table = KeyedFiles(spark, place(spark, "keyed"), "id long, v string, at long", ["id"], 16)
    assert table.read().count() == 0
    table.upsert(spark.range(200).selectExpr("id", "'a' AS v", "0L AS at"), "at")
    before = table.manifest()
    files = set(table.read().inputFiles())
    table.upsert(spark.createDataFrame([(5, "b", 1), (6, "late", -1), (1000, "new", 1)], "id long, v string, at long"), "at")
    after = table.manifest()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) <= 3 and len(files & set(table.read().inputFiles())) >= 13
    got = {r["id"]: r["v"] for r in table.read().collect()}
    assert len(got) == 201 and got[5] == "b" and got[6] == "a" and got[1000] == "new"


def test_a_repeated_change_does_the_same(spark):
    table = KeyedFiles(spark, place(spark, "keyed"), "id long, n long", ["id"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    rows = spark.createDataFrame([(1, 2), (2, 3)], "id long, n long")
    table.change(rows, add, 0)
    table.change(rows, add, 1)
    table.change(rows, add, 1)  # the micro-batch once more
    assert {tuple(r) for r in table.read().collect()} == {(1, 4), (2, 6)}
    table.change(rows, lambda old, new: old.join(new, "id", "left_anti"), 2)
    assert table.read().count() == 0 and table.manifest() == {}


def test_counters_take_back(spark):
    rows = [(1, 0, "repairing"), (2, 1, "repairing"), (1, 2, None), (1, 3, "done"), (2, 4, "done"), (3, 5, "repairing"), (1, 6, "repairing")]
    table = spark.createDataFrame(rows, "key long, event_id long, status string")
    path = laid_down(table, "key", [F.col("event_id") == k for k in range(7)], "counters")
    out, _ = run_to_end(status_changes_stream(stream_of(spark, path, table.schema, 1)), "counters")
    assert {tuple(r) for r in out.groupBy("status").agg(F.sum("change")).collect()} == {("done", 1), ("repairing", 2)}


def test_trailing_samples(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), e, rng.randrange(1000)) for e in range(200)]
    table, stream, base = timed(spark, rows, "key long, event_id long, t long", 4)
    want = {}
    for key in range(3):
        samples = []
        for n, (_, event, t) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])), 1):
            samples.append((t, n))
            while len(samples) > 2 and samples[1][0] < t - 60:
                samples.pop(0)
            want[event] = (n - samples[0][1], t - samples[0][0])
    out, _ = run_to_end(trailing_stream(stream, 60), "trailing")
    assert {r["event_id"]: (r["done"], r["span"]) for r in out.collect()} == want


def test_progress_lines_in_order(spark):
    import json

    rows = [(i, f"t {i}", ["repaired-missing", "skipped-good", "failed"][i % 3], i * 10) for i in range(50)]
    path = place(spark, "lines")
    write_progress(spark.createDataFrame(rows, "id long, title string, status string, elapsed long").repartition(5), path)
    lines = [json.loads(x) for part in ("head", "body", "tail") for _, x in sorted(((f, i), x) for f, text in spark.sparkContext.wholeTextFiles(f"{path}/{part}").collect() for i, x in enumerate(text.splitlines()))]
    assert lines[0] == {"type": "started", "total": 50} and lines[-1]["summary"] == {"scanned": 50, "repaired": 17, "repairedMissing": 17, "repairedBlack": 0, "repairedBroken": 0, "repairedProblematic": 0, "skippedGood": 17, "notFound": 0, "failed": 16}
    told = [(x["type"], x["videoId"]) for x in lines[1:-1]]
    assert told == [(t, i) for i in range(50) for t in ("video-start", *(["video-phase"] if i % 3 == 0 else []), "video-done")] and [x["index"] for x in lines if "index" in x] == list(range(1, 51))
    assert read_progress(spark, path).count() == len(lines)
    none = place(spark, "lines")
    write_progress(spark.createDataFrame([], "id long, title string, status string, elapsed long"), none)
    assert sorted(r["type"] for r in read_progress(spark, none).collect()) == ["started", "summary"]


def test_jobs_that_are_done_leave_the_state(spark):
    from shelfwise.streaming.jobs import folded_jobs, folded_jobs_stream

    rows = [(job, 10 * job + i, name, claim, 100_000 * job + i) for job in range(40) for i, (name, claim) in enumerate((("claim", 0), ("complete", 1), ("retry", 1)) if job % 4 else (("claim", 0), ("fail", 1)))]
    table, stream, _ = timed(spark, rows, "job long, event_id long, name string, claim long, t long", 5)
    out, ended = run_to_end(folded_jobs_stream(stream, 200_000), "done")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in folded_jobs(table).collect()}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in ended.recentProgress]
    assert kept[-1] <= 10 + 3 and max(kept) < 30, kept  # the failed ones, and those that were done lately
