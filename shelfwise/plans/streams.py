"""State over event streams: in batches by windows and folds, and with Structured Streaming where state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.keyed import KeyedFiles
from shelfwise.sources.shared import written
from shelfwise.streaming.feeds import Slices, place, run_in_turns
from shelfwise.streaming.fragments import indexed_stream
from shelfwise.streaming.jobs import folded_jobs, folded_jobs_stream
from shelfwise.streaming.leases import lapsed, lapsed_stream
from shelfwise.streaming.limits import latest_value, limited, limited_stream
from shelfwise.streaming.progress import PATCH, lines_of, merged_patches, merged_patches_stream, read_progress, status_changes_stream, trailing_stream, write_progress
from shelfwise.streaming.shards import shards_for


def requests(rows: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return rows.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("key"), F.unix_millis(at).alias("t"), at.alias("at"))


def arrivals(rows: DataFrame, at: str, key: str, parts: int = 3) -> Slices:
    """rows as they arrive in the order of at: so many equal spans of it, one after the other."""
    ends = rows.agg(F.min(at).cast("double").alias("a"), F.max(at).cast("double").alias("b")).first()
    step = max((ends["b"] - ends["a"]) / parts, 1e-9) if ends["a"] is not None else 1.0
    span = F.least(F.floor((F.col(at).cast("double") - F.lit(ends["a"] or 0.0)) / step), F.lit(parts - 1))
    return Slices(rows, key, [span == k for k in range(parts)])


LIMIT_SQL = """WITH RECURSIVE e AS (SELECT event_id, event_type || ':' || (user_id % 20) AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type, user_id % 20 ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT event_id, key, t, n, CAST(1 AS BIGINT) AS count, t + 3600000 AS reset FROM e WHERE n = 1 UNION ALL
        SELECT e.event_id, e.key, e.t, e.n, CASE WHEN e.t >= reset THEN 1 ELSE count + 1 END, CASE WHEN e.t >= reset THEN e.t + 3600000 ELSE reset END FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
    SELECT event_id, key, t, count <= 3 AS allowed, greatest(0, 3 - count) AS remaining, CASE WHEN count <= 3 THEN 0 ELSE greatest(1, CAST(ceil((reset - t) / 1000.0) AS BIGINT)) END AS retry_after FROM s"""


@query("stm_01_request_limit", LIMIT_SQL)
def request_limit(lib: Library) -> DataFrame:
    """Windows begin with a key's first request, so no tumbling window; checked against the stream, too."""
    return limited(requests(lib.raw("events")), 3, 3_600_000)


@query("stm_01_request_limit_stream", LIMIT_SQL)
def request_limit_stream(lib: Library) -> DataFrame:
    """In several micro-batches; a key's state goes when its window is over."""
    events = arrivals(requests(lib.raw("events")), "at", "key")
    return run_in_turns(events, "limit", lambda stream: limited_stream(stream.withWatermark("at", "0 seconds"), 3, 3_600_000))


@query("stm_02_latest_per_key", "SELECT CAST(user_id % 5 AS INTEGER) AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY ALL")
def latest_per_key(lib: Library) -> DataFrame:
    """The history as it stands after the stream of views: each micro-batch is upserted into the buckets that it touches."""
    views = lib.raw("events").where("event_type = 'view'").select((F.col("user_id") % 5).cast("int").alias("user_id"), F.get_json_object("props", "$.k").cast("long").alias("video_id"), "ts")
    history = KeyedFiles(lib.spark, place(lib.spark, "history"), "user_id int, video_id long, ts timestamp_ntz", ["user_id", "video_id"], 8)
    source = arrivals(views.withColumn("at", F.col("ts").cast("timestamp")), "at", "video_id")
    run_in_turns(source, "history", lambda stream: stream.drop("at"), lambda rows, number: history.upsert(rows, "ts", number))
    return history.read()


@query("stm_03_progress", """SELECT user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, event_id) FILTER (WHERE event_id % 3 <> 0) AS phase, max(event_id) AS last FROM events GROUP BY user_id""")
def progress(lib: Library) -> DataFrame:
    """Patches with gaps: each field keeps its last value that is not null."""
    rows = lib.raw("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("phase"))
    return rows.groupBy("user_id").agg(latest_value("phase", "event_id").alias("phase"), F.max("event_id").alias("last"))


def patches(lib: Library) -> DataFrame:
    """Progress of a user's work by events, most fields null, and where each lies in time."""
    return lib.raw("events").select(
        F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.expr("CASE WHEN event_id % 3 <> 0 THEN event_type END").alias("phase"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 100 AS BIGINT) END").alias("total"), F.expr("CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS BIGINT) END").alias("processed"),
        F.col("ts").cast("timestamp").alias("at"),
    )


PATCHES = "SELECT CAST(user_id AS BIGINT) AS key, event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS phase, CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 100 AS BIGINT) END AS total, CASE WHEN event_id % 5 = 0 THEN event_id END AS processed FROM events"
MERGED = "SELECT key, coalesce(arg_max(phase, event_id) FILTER (WHERE phase IS NOT NULL), 'starting') AS phase, arg_max(total, event_id) FILTER (WHERE total IS NOT NULL) AS total, coalesce(arg_max(processed, event_id) FILTER (WHERE processed IS NOT NULL), 0) AS processed, max(event_id) AS last FROM p GROUP BY key"


@query("stm_03_merged_patches", f"WITH p AS ({PATCHES}) {MERGED}")
def merged(lib: Library) -> DataFrame:
    return merged_patches(patches(lib))


def json_lines(lib: Library) -> Slices:
    """The patches as lines of JSON that arrive in files, some of them broken; broken ones are passed over."""
    rows = lines_of(patches(lib)).withColumn("value", F.expr("CASE WHEN event_id % 97 = 5 THEN left(value, length(value) - 3) ELSE value END"))
    ends = rows.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    cut = [((ends["b"] or 0) - (ends["a"] or 0)) * k // 3 + (ends["a"] or 0) for k in (1, 2)]
    parts = [F.col("event_id") <= cut[0], F.col("event_id").between(cut[0] + 1, cut[1]), F.col("event_id") > cut[1]]
    return Slices(rows, "key", parts, ("text", "json"), ["value"], f"{PATCH}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def whole_lines(lines: DataFrame) -> DataFrame:
    return lines.where("broken IS NULL AND key IS NOT NULL").drop("broken")


@query("stm_03_progress_stream", f"WITH p AS (SELECT * FROM ({PATCHES}) WHERE event_id % 97 <> 5) {MERGED}")
def progress_stream(lib: Library) -> DataFrame:
    """Lines of JSON merged by key over several micro-batches, each of which upserts the rows that it changed."""
    table = KeyedFiles(lib.spark, place(lib.spark, "progress"), "key long, phase string, total long, processed long, last long", ["key"], 8)
    upsert = lambda rows, number: table.upsert(written(rows, "progress-changes"), "last", number)  # noqa: E731  a change reads its rows twice
    run_in_turns(json_lines(lib), "progress", lambda lines: merged_patches_stream(whole_lines(lines)), upsert, "update")
    return table.read()


@query("stm_14_live_counters_stream", f"WITH p AS (SELECT * FROM ({PATCHES}) WHERE event_id % 97 <> 5), s AS (SELECT key, arg_max(phase, event_id) FILTER (WHERE phase IS NOT NULL) AS status FROM p GROUP BY key) SELECT status, count(*) AS n FROM s WHERE status IS NOT NULL GROUP BY status")
def live_counters_stream(lib: Library) -> DataFrame:
    """Keys counted by their last status, kept up to date: one that moves on is taken back from where it was."""
    shards = shards_for(lib.raw("events").count())
    changes = run_in_turns(json_lines(lib), "counters", lambda lines: status_changes_stream(whole_lines(lines).select("key", "event_id", F.col("phase").alias("status")), shards))
    return changes.groupBy("status").agg(F.sum("change").alias("n")).where("n <> 0")


#: What an estimate needs to begin, and the items that count as nearly none.
WARM_MS, WARM_ITEMS, NEARLY = 4000, 5, 3


def eta(span, done, left):
    """struct<kind, ms>: no estimate before the warm-up; nearly done with at most NEARLY items left."""
    ready = (span >= WARM_MS) & (done >= WARM_ITEMS)
    kind = F.when(left <= NEARLY, "almost-done").when(ready & left.isNotNull(), "estimate").otherwise("calculating")
    return F.struct(kind.alias("kind"), F.when(kind == "estimate", F.ceil(left * span / done)).alias("ms"))


@query("stm_04_eta", """WITH m AS (SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS span, count(*) - 1 AS done, 120 - count(*) AS rest FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN rest <= 3 THEN 'almost-done' WHEN span >= 4000 AND done >= 5 THEN 'estimate' ELSE 'calculating' END AS kind, CASE WHEN rest > 3 AND span >= 4000 AND done >= 5 THEN CAST(ceil(rest * span / done) AS BIGINT) END AS ms FROM m""")
def etas(lib: Library) -> DataFrame:
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    each = lib.raw("events").groupBy("user_id").agg((ms(F.max("ts")) - ms(F.min("ts"))).alias("span"), (F.count("*") - 1).alias("done"), (120 - F.count("*")).alias("left"))
    return each.select("user_id", eta(F.col("span"), F.col("done"), F.col("left")).alias("e")).select("user_id", "e.*")


def indexed(fragments: DataFrame) -> DataFrame:
    """stream, fragments, gaps, frontier. Fragments are taken in order of their bytes: one that lies wholly behind the frontier counts no more, and after a gap the index goes on from where bytes are again."""
    order = Window.partitionBy("stream").orderBy("first_byte", "end_byte").rowsBetween(Window.unboundedPreceding, -1)
    rows = fragments.withColumn("reached", F.max("end_byte").over(order)).where(F.col("end_byte") > F.coalesce("reached", F.lit(0)))
    return rows.groupBy("stream").agg(F.count("*").alias("fragments"), F.count_if(F.col("first_byte") > F.coalesce("reached", "first_byte")).alias("gaps"), F.max("end_byte").alias("frontier"))


@query("stm_05_fragment_index", """WITH f AS (SELECT * FROM fragment WHERE (stream + idx) % 5 <> 0), r AS (SELECT *, lag(end_byte) OVER (PARTITION BY stream ORDER BY idx) AS before FROM f)
    SELECT stream, count(*) AS fragments, count(*) FILTER (WHERE before < first_byte) AS gaps, max(end_byte) AS frontier FROM r GROUP BY stream""")
def fragment_index(lib: Library) -> DataFrame:
    """Streams of which some fragments are missing and some come twice."""
    rows = lib.fragment.where("(stream + idx) % 5 <> 0")
    return indexed(rows.unionByName(rows.where("idx % 3 = 0")).repartition(lib.parts("lineitem"), "stream"))


#: Bytes of a piece, clocks of the tracks, and the track of the picture, in the streams that stand for files here.
PIECE, SCALES, VIDEO = 40, {1: 1000, 2: 48_000}, 1
_TRAF = "concat('0000002C74726166', '000000107466686400000000', lpad(hex(CAST({0} AS BIGINT)), 8, '0'), '000000147466647401000000', lpad(hex(CAST({1} AS BIGINT)), 16, '0'))"
_TRAFS = f"""CASE WHEN stream % 13 = 0 AND idx = 3 THEN {_TRAF.format('9', '5')} WHEN idx % 4 = 0 THEN {_TRAF.format('2', 'start_time * 48000 + 24000')}
    WHEN idx % 2 = 1 THEN concat({_TRAF.format('2', 'start_time * 48000')}, {_TRAF.format('1', 'start_time * 1000 + 250')}) ELSE {_TRAF.format('1', 'start_time * 1000 + 250')} END"""


def pieces(lib: Library) -> DataFrame:
    """Streams of boxes, made of the fragments, in pieces: some come twice, some overlap, and some streams lose all but the first of a fragment. slice: when a piece arrives."""
    rows = lib.fragment.select("stream", "idx", "start_time", F.expr("(end_byte - first_byte) div 100").alias("length"), F.expr(_TRAFS).alias("trafs"))
    movie = "concat(lpad(hex(24 + length(trafs) div 2), 8, '0'), '6D6F6F66', '000000106D66686400000000', lpad(hex(CAST(idx AS BIGINT)), 8, '0'), trafs)"
    rows = rows.withColumn("data", F.expr(f"unhex(concat({movie}, lpad(hex(8 + length), 8, '0'), '6D646174', repeat('00', CAST(length AS INT)), CASE WHEN idx % 3 = 0 THEN '0000000866726565' ELSE '' END))"))
    own = Window.partitionBy("stream")
    before = F.coalesce(F.sum(F.length("data")).over(own.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"begin": before, "most": F.max("idx").over(own)})
    rows = rows.select("stream", "idx", "begin", "most", "data", F.explode(F.sequence(F.lit(0), F.length("data") - 1, F.lit(PIECE))).alias("k"))
    early = F.when((F.col("idx") % 4 == 2) & (F.col("k") == PIECE), 10).otherwise(0)
    rows = rows.where("NOT (stream % 10 = 3 AND idx = 2 AND k > 0 AND most > 2)")
    last = (F.col("idx") == F.col("most")) & (F.col("k") + PIECE >= F.length("data"))
    rows = rows.select("stream", "idx", "most", "k", (F.col("begin") + F.col("k") - early).alias("first_byte"), F.substring(F.col("data"), F.col("k") - early + 1, early + PIECE).alias("data"), last.alias("last"), F.expr("CASE WHEN k = 0 THEN (idx - 1) div 2 ELSE idx div 2 END").alias("slice"))
    again = rows.where("idx % 4 = 1 AND k = 0 AND idx < most").withColumn("slice", F.col("slice") + 1)
    return rows.unionByName(again).select("stream", "first_byte", "data", "last", F.least("slice", F.lit(3)).alias("slice"))


@query("stm_05_fragment_index_stream", """WITH f AS (SELECT stream, idx, start_time, (end_byte - first_byte) // 100 AS length, CASE WHEN idx % 2 = 1 AND NOT (stream % 13 = 0 AND idx = 3) THEN 112 ELSE 68 END AS movie, max(idx) OVER (PARTITION BY stream) AS most FROM fragment),
    b AS (SELECT *, CAST(coalesce(sum(movie + 8 + length + CASE WHEN idx % 3 = 0 THEN 8 ELSE 0 END) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM f)
    SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY idx) - 1 AS idx, start_time + CASE WHEN idx % 4 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS start_time, begin AS first_byte, begin + movie + 8 + length AS end_byte, CAST(idx AS BIGINT) AS sequence
    FROM b WHERE NOT (stream % 13 = 0 AND idx = 3) AND NOT (stream % 10 = 3 AND idx = 2 AND most > 2)""")
def fragment_index_stream(lib: Library) -> DataFrame:
    """The picture's clock tells a fragment's time, where it has one; fragments of which bytes are lost, or no clock is known, are not found."""
    rows = written(pieces(lib), "pieces")
    source = Slices(rows, "stream", [F.col("slice") == k for k in range(4)], columns=["stream", "first_byte", "data", "last"], schema="stream long, first_byte long, data binary, last boolean")
    shards = shards_for(lib.raw("lineitem").count())
    return run_in_turns(source, "fragments", lambda stream: indexed_stream(stream, SCALES, VIDEO, shards))


#: The names that events of the test table stand for; the claim that an event belongs to follows from its number, so that some come too late.
NAMED = ("claim", "complete", "fail", "release", "retry", "unsupported")


#: How long a job that is done stays known to the stream, in ms.
KEPT = 60 * 86_400_000


def job_events(rows: DataFrame, *more: str) -> DataFrame:
    """job, event_id, name, claim, and more columns."""
    name = F.get(F.array(*map(F.lit, NAMED)), (F.col("event_id") % 6).cast("int"))
    return rows.select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), name.alias("name"), F.floor(F.col("event_id") % 97 / 24).cast("long").alias("claim"), *more)


def last_states(decided: DataFrame) -> DataFrame:
    return decided.groupBy("job").agg(F.max_by(F.struct("state", "claims"), "event_id").alias("s")).select(F.col("job").alias("user_id"), "s.state", "s.claims")


STATES_SQL = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 6 AS k, (event_id % 97) // 24 AS claim FROM events),
    s AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS n, 'pending' AS state, CAST(0 AS BIGINT) AS claims FROM events UNION ALL
        SELECT s.user_id, e.n, CASE WHEN state = 'pending' AND k = 0 THEN 'generating' WHEN state = 'failed' AND k = 4 THEN 'pending' WHEN state <> 'generating' OR claim <> claims OR k IN (0, 4) THEN state WHEN k = 1 THEN 'completed' WHEN k = 2 THEN 'failed' WHEN k = 3 THEN 'pending' ELSE 'unsupported' END,
            claims + CASE WHEN state = 'pending' AND k = 0 THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, arg_max(state, n) AS state, max(claims) AS claims FROM s GROUP BY user_id"""


@query("stm_08_job_states", STATES_SQL)
def job_states(lib: Library) -> DataFrame:
    """Events of a job folded into its state, in order; what a worker says counts only under the claim that is in force."""
    return last_states(folded_jobs(job_events(lib.raw("events"))))


@query("stm_08_job_states_stream", STATES_SQL)
def job_states_stream(lib: Library) -> DataFrame:
    """The same as a stream, whose state is kept by job; checked against the batch."""
    at = F.col("ts").cast("timestamp")
    rows = lib.raw("events").select("*", F.unix_millis(at).alias("t"), at.alias("at"))
    events = lambda stream: job_events(stream.withWatermark("at", "0 seconds"), "t", "at")
    return last_states(run_in_turns(arrivals(rows, "at", "user_id"), "jobs", lambda stream: folded_jobs_stream(events(stream), KEPT)))


LEASE = 43_200_000
#: What events of the test table stand for.
LEASED = ("claim", "claim", "begin", "heartbeat", "complete", "enqueue", "claim")


def lease_events(lib: Library) -> DataFrame:
    name = F.get(F.array(*map(F.lit, LEASED)), (F.col("event_id") % 7).cast("int"))
    at = F.col("ts").cast("timestamp")
    return lib.raw("events").select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), name.alias("name"), F.unix_millis(at).alias("t"), at.alias("at"))


LEASE_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS job, epoch_us(ts) // 1000 AS t, event_id % 7 AS k, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(-1 AS BIGINT) AS lease, 0 AS attempts, 0 AS recoveries, CAST(-1 AS BIGINT) AS retry_at, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS VARCHAR) AS ended_as, 0 AS had FROM e UNION ALL
        SELECT job, n, CASE WHEN k IN (0, 1, 6) AND st = 'pending' AND t >= ra THEN 'generating' WHEN k = 5 AND st IN ('completed', 'failed') THEN 'pending' WHEN k = 4 AND st = 'generating' THEN 'completed' ELSE st END,
            CASE WHEN k IN (0, 1, 6) AND st = 'pending' AND t >= ra THEN t + 43200000 WHEN st = 'generating' AND (k = 3 OR (k = 2 AND attempts < 3)) THEN t + 43200000 WHEN st = 'generating' AND k <> 4 THEN lease ELSE -1 END,
            CASE WHEN k = 5 AND st IN ('completed', 'failed') THEN 0 WHEN k = 2 AND st = 'generating' AND attempts < 3 THEN attempts + 1 ELSE attempts END, CASE WHEN k = 5 AND st IN ('completed', 'failed') THEN 0 ELSE rc END,
            CASE WHEN k = 5 AND st IN ('completed', 'failed') THEN t ELSE ra END, CASE WHEN x THEN lease END, CASE WHEN x THEN CASE WHEN attempts >= 3 THEN 'max_attempts' WHEN recoveries + 1 >= 5 THEN 'worker_recovery_exhausted' ELSE 'lease_expired' END END, recoveries + 1
        FROM (SELECT *, CASE WHEN NOT x THEN status WHEN attempts >= 3 OR recoveries + 1 >= 5 THEN 'failed' ELSE 'pending' END AS st, recoveries + CASE WHEN x THEN 1 ELSE 0 END AS rc,
                CASE WHEN NOT x THEN retry_at WHEN attempts >= 3 OR recoveries + 1 >= 5 THEN lease ELSE lease + least(60000 * CAST(pow(2, recoveries) AS BIGINT), 900000) END AS ra
            FROM (SELECT s.job, e.n, e.t, e.k, s.status, s.lease, s.attempts, s.recoveries, s.retry_at, s.status = 'generating' AND s.lease < e.t AS x FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1))),
    z AS (SELECT job, ended AS at_ms, ended_as AS error_code, had AS recoveries FROM s WHERE ended IS NOT NULL UNION ALL
        SELECT job, lease, CASE WHEN attempts >= 3 THEN 'max_attempts' WHEN recoveries + 1 >= 5 THEN 'worker_recovery_exhausted' ELSE 'lease_expired' END, recoveries + 1 FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1) WHERE status = 'generating' AND lease < (SELECT max(t) FROM e))
    SELECT job, at_ms AS "at", CASE error_code WHEN 'lease_expired' THEN 'pending' ELSE 'failed' END AS status, error_code, CAST(recoveries AS BIGINT) AS recoveries, at_ms + CASE error_code WHEN 'lease_expired' THEN least(60000 * CAST(pow(2, recoveries - 1) AS BIGINT), 900000) ELSE 0 END AS next_retry_at FROM z"""


@query("stm_09_lapsed_leases", LEASE_SQL)
def lapsed_leases(lib: Library) -> DataFrame:
    """Every time that a job went back because its worker fell silent, up to the last event."""
    return lapsed(lease_events(lib), LEASE)


@query("stm_09_lapsed_leases_stream", LEASE_SQL)
def lapsed_leases_stream(lib: Library) -> DataFrame:
    """The same by timers: a job goes back when the watermark passes its lease."""
    return run_in_turns(arrivals(lease_events(lib), "at", "job"), "leases", lambda stream: lapsed_stream(stream.withWatermark("at", "0 seconds"), LEASE))


@query("stm_11_resume_point", "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'restart' WHEN p_size * 10 > p_partkey THEN 'resume' ELSE 'trust-file' END AS action, CASE WHEN p_size % 7 = 0 THEN 0 ELSE least(p_size * 10, p_partkey) END AS frontier FROM part")
def resume_point(lib: Library) -> DataFrame:
    """A file against its manifest: of another source, start again; else go on from the shorter of the two."""
    other, manifest, file = F.col("p_size") % 7 == 0, F.col("p_size") * 10, F.col("p_partkey")
    action = F.when(other, "restart").when(manifest > file, "resume").otherwise("trust-file")
    return lib.raw("part").select(file.alias("id"), action.alias("action"), F.when(other, 0).otherwise(F.least(manifest, file)).alias("frontier"))


TRAILING_SQL = """WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    p AS (SELECT e.user_id, e.event_id, e.n, e.t, (SELECT max(f.n) FROM e f WHERE f.user_id = e.user_id AND f.n <= e.n AND f.t < e.t - 86400000) AS before FROM e)
    SELECT user_id, event_id, CAST(n - greatest(1, least(coalesce(before, 1), n - 1)) AS BIGINT) AS done FROM p"""


@query("stm_13_trailing_rate", TRAILING_SQL)
def trailing_rate(lib: Library) -> DataFrame:
    """Items done since the last sample before the trailing day, which stays; at least two samples count."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = lib.raw("events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.row_number().over(own).alias("n"))
    trailing = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -86_400_001)
    before = F.coalesce(F.max("n").over(trailing), F.lit(1))
    return rows.select("user_id", "event_id", (F.col("n") - F.greatest(F.lit(1), F.least(before, F.col("n") - 1))).cast("long").alias("done"))


@query("stm_13_trailing_rate_stream", TRAILING_SQL)
def trailing_rate_stream(lib: Library) -> DataFrame:
    """The same over several micro-batches, with the samples of the trailing day in each key's state."""
    at = F.col("ts").cast("timestamp")
    rows = lib.raw("events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_millis(at).alias("t"), at.alias("at"))
    shards = shards_for(lib.raw("events").count())
    found = run_in_turns(arrivals(rows, "at", "key"), "samples", lambda stream: trailing_stream(stream, 86_400_000, shards))
    return found.select(F.col("key").alias("user_id"), "event_id", "done")


@query("stm_14_live_counters", "SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id) GROUP BY status")
def live_counters(lib: Library) -> DataFrame:
    """Events folded by key, and keys counted by what came last."""
    return lib.raw("events").groupBy("user_id").agg(latest_value("event_type", "event_id").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


RESULTS = ("repaired-missing", "repaired-black", "repaired-broken", "repaired-problematic", "skipped-good", "not-found", "failed")


@query("snk_07_progress_lines", f"""WITH r AS (SELECT id, title, {list(RESULTS)}[id % 7 + 1] AS status, file_size % 1000 AS elapsed, row_number() OVER (ORDER BY id) AS index FROM video WHERE duration IS NULL), n AS (SELECT count(*) AS total FROM r)
    SELECT 'started' AS type, NULL AS "videoId", NULL AS title, NULL AS index, total, NULL AS phase, NULL AS category, NULL AS status, NULL AS "elapsedMs", NULL AS scanned, NULL AS repaired, NULL AS black FROM n UNION ALL
    SELECT 'video-start', id, title, index, total, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r, n UNION ALL SELECT 'video-phase', id, title, NULL, NULL, 'repairing', status, NULL, NULL, NULL, NULL, NULL FROM r WHERE id % 7 < 4 UNION ALL
    SELECT 'video-done', id, title, NULL, NULL, NULL, NULL, status, elapsed, NULL, NULL, NULL FROM r UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE id % 7 < 4), count(*) FILTER (WHERE id % 7 = 1) FROM r""")
def progress_lines(lib: Library) -> DataFrame:
    """A run's progress as lines of JSON, written and read back."""
    status = F.get(F.array(*map(F.lit, RESULTS)), (F.col("id") % 7).cast("int"))
    rows = lib.video.where("duration IS NULL").select("id", "title", status.alias("status"), (F.col("file_size") % 1000).alias("elapsed"))
    path = place(lib.spark, "lines")
    write_progress(rows, path)
    read = read_progress(lib.spark, path)
    return read.select("*", *[F.try_element_at("summary", F.lit(k)).alias(n) for k, n in (("scanned", "scanned"), ("repaired", "repaired"), ("repairedBlack", "black"))]).drop("summary")
