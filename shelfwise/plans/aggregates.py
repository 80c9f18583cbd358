"""Counts, sums, order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.scope import is_own, with_owner
from shelfwise.plans.filters import OWN, OWNED
from shelfwise.registry import query
from shelfwise.sources.catalog import Library

STATUSES = ("pending", "queued", "generating", "failed", "unsupported", "completed")


@query("agg_01_filtered_count", f"WITH o AS ({OWNED}) SELECT count(*) AS n FROM o WHERE {OWN.format(1)}")
def filtered_count(lib: Library) -> DataFrame:
    return with_owner(lib.video, lib.account).where(is_own(1)).agg(F.count("*").alias("n"))


@query("agg_02_group_count", "SELECT status, count(*) AS n FROM job GROUP BY status")
def group_count(lib: Library) -> DataFrame:
    return lib.job.groupBy("status").agg(F.count("*").alias("n"))


def status_counts():
    """One count per status, 0 where there is none."""
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


@query("agg_03_pivoted_counts", "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + " FROM job")
def pivoted_counts(lib: Library) -> DataFrame:
    return lib.job.agg(*status_counts())


@query("agg_04_count_per_parent", "SELECT f.id, f.name, count(s.video_id) AS videos FROM folder f LEFT JOIN saved s ON s.folder_id = f.id GROUP BY ALL")
def count_per_parent(lib: Library) -> DataFrame:
    """Empty folders count 0."""
    counts = lib.saved.where("folder_id IS NOT NULL").groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n"))
    return lib.folder.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("videos"))


@query("agg_05_conditional_sum", "SELECT count(*) AS total, count(*) FILTER (WHERE done) AS completed, count(*) - count(*) FILTER (WHERE done) AS missing, CAST(coalesce(sum(file_size) FILTER (WHERE done), 0) AS BIGINT) AS bytes FROM (SELECT v.id, v.file_size, EXISTS (SELECT 1 FROM job j WHERE j.video_id = v.id AND j.status = 'completed') AS done FROM video v)")
def conditional_sum(lib: Library) -> DataFrame:
    done = lib.job.where("status = 'completed'").select(F.col("video_id").alias("id"), F.lit(True).alias("done")).distinct()
    rows = lib.video.select("id", "file_size").join(done, "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("done").alias("completed"), (F.count("*") - F.count("done")).alias("missing"), F.coalesce(F.sum(F.when(F.col("done"), F.col("file_size"))), F.lit(0)).alias("bytes"))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: sorted[n // 2], of an even number of values the upper of the middle two. Values are counted first, so that only different ones are put in order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    upto = F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumns({"upto": upto, "half": F.floor(F.sum("n").over(own) / 2)}).where("upto > half")
    return middle.groupBy(key).agg(F.min(value).alias("median"))


@query("agg_07_upper_median", "SELECT account_id, list_sort(list(duration))[len(list(duration)) // 2 + 1] AS median FROM video WHERE duration IS NOT NULL GROUP BY account_id")
def medians(lib: Library) -> DataFrame:
    return upper_medians(lib.video.where("duration IS NOT NULL"), "account_id", "duration")


@query("agg_09_every_member", "SELECT video_id, bool_and(status = 'failed') AS all_failed FROM job GROUP BY video_id")
def every_member(lib: Library) -> DataFrame:
    return lib.job.groupBy("video_id").agg(F.bool_and(F.col("status") == "failed").alias("all_failed"))


@query("agg_10_outcomes", "SELECT priority, count(*) FILTER (WHERE error_code = 'network') AS network, count(*) FILTER (WHERE error_code = 'max_attempts') AS max_attempts, count(*) FILTER (WHERE error_code = 'unsupported_codec') AS unsupported_codec FROM job WHERE error_code IS NOT NULL GROUP BY priority")
def outcomes(lib: Library) -> DataFrame:
    return lib.job.where("error_code IS NOT NULL").groupBy("priority").pivot("error_code", ["network", "max_attempts", "unsupported_codec"]).count().na.fill(0)


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """For each group sorted[min(n - 1, floor(p / 100 * (n - 1)))], rounded to one decimal; rows are ranked, not gathered."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = rows.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(*by))})
    at = lambda p: F.least(F.col("__n") - 1, F.floor(F.lit(p) * (F.col("__n") - 1) / 100))
    return ranked.groupBy(*by).agg(*[F.round(F.max(F.when(F.col("__i") == at(p), F.col(value))), 1).alias(f"p{p}") for p in percents])


@query("agg_11_nearest_rank_percentiles", """SELECT event_type, round(list_sort(list(value))[CAST(floor(50 * (count(*) - 1) / 100) AS BIGINT) + 1], 1) AS p50,
    round(list_sort(list(value))[CAST(floor(95 * (count(*) - 1) / 100) AS BIGINT) + 1], 1) AS p95, round(list_sort(list(value))[CAST(floor(100 * (count(*) - 1) / 100) AS BIGINT) + 1], 1) AS p100 FROM events GROUP BY event_type""")
def percentiles(lib: Library) -> DataFrame:
    return nearest_rank(lib.raw("events").select("event_type", "value"), "value", [50, 95, 100], ["event_type"])


@query("agg_12_summary", "SELECT event_type, min(user_id) AS least, list_sort(list(user_id))[count(*) // 2 + 1] AS p50, max(user_id) AS most FROM events GROUP BY event_type")
def summary(lib: Library) -> DataFrame:
    rows = lib.raw("events").select("event_type", "user_id")
    ends = rows.groupBy("event_type").agg(F.min("user_id").alias("least"), F.max("user_id").alias("most"))
    return ends.join(upper_medians(rows, "event_type", "user_id").withColumnRenamed("median", "p50"), "event_type")


@query("agg_13_mean_and_vote", "SELECT l_orderkey AS stream, count(*) FILTER (WHERE l_quantity >= 20) * 3 >= 2 * count(*) AS usable, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def mean_and_vote(lib: Library) -> DataFrame:
    """Frames of a scene: usable if two thirds are bright enough."""
    return lib.raw("lineitem").groupBy(F.col("l_orderkey").alias("stream")).agg((F.count_if(F.col("l_quantity") >= 20) * 3 >= 2 * F.count("*")).alias("usable"), F.sum("l_quantity").cast("long").alias("total"))


#: A clock of 33 bits at 90 kHz; readings that either sample needs, how far from its edge the outermost may be (a part of the sample), durations (s) and bit rates (bit/s) that are believed.
CLOCK_SECONDS, READINGS, EDGE = (1 << 33) / 90_000, 3, 0.5
SHORTEST, LONGEST, SLOWEST, FASTEST = 1, 12 * 3600, 32_000, 40_000_000


def clock_duration(ticks: DataFrame, samples: DataFrame) -> DataFrame:
    """stream, pid, seconds of the first program whose readings can be believed, in the order of their number (then of the first seen).

    ticks: stream, pid, at (byte), t (seconds). samples: stream, head_at, head_size, tail_at, tail_size, size (bytes). The duration lies between the
    earliest reading of the head and the latest of the tail; a smaller one is of the clock's next turn. Streams without such a program are left out.
    """
    in_head, in_tail = F.col("at") < F.col("head_at") + F.col("head_size"), F.col("at") >= F.col("tail_at")
    rows = ticks.join(samples, "stream")
    each = rows.groupBy("stream", "pid").agg(
        F.count("*").alias("n"), F.min("at").alias("seen"), F.count_if(in_head).alias("heads"), F.count_if(in_tail).alias("tails"),
        F.min(F.when(in_head, F.struct("t", (-F.col("at")).alias("back")))).alias("first"), F.max(F.when(in_tail, F.struct("t", "at"))).alias("last"),
        *[F.first(c).alias(c) for c in samples.columns if c != "stream"],
    )
    begin, end = F.col("first.t"), F.col("last.t")
    seconds = F.when(end < begin, end + F.lit(CLOCK_SECONDS)).otherwise(end) - begin
    covered = (-F.col("first.back") - F.col("head_at") <= F.col("head_size") * EDGE) & (F.col("tail_at") + F.col("tail_size") - F.col("last.at") <= F.col("tail_size") * EDGE)
    each = each.where((F.col("heads") >= READINGS) & (F.col("tails") >= READINGS) & covered).withColumn("seconds", seconds)
    rate = F.col("size") * 8 / F.col("seconds")
    each = each.where((F.col("seconds") > SHORTEST) & (F.col("seconds") <= LONGEST)).where((rate > SLOWEST) & (rate < FASTEST))
    return each.groupBy("stream").agg(F.min(F.struct(-F.col("n"), "seen", "pid", "seconds")).alias("best")).select("stream", F.col("best.pid").alias("pid"), F.round("best.seconds", 6).alias("seconds"))


TICKS = """SELECT l_suppkey AS stream, CASE WHEN l_orderkey % 7 < l_suppkey % 5 THEN 257 ELSE 256 + l_orderkey % 2 * 2 END AS pid, l_orderkey * 188 AS place,
    (l_orderkey / 100.0 + 95443.717 - CASE WHEN l_suppkey % 3 = 0 THEN 25 ELSE 2000 END) % CAST(8589934592 / 90000.0 AS DOUBLE) AS t FROM lineitem"""
SAMPLES = """SELECT stream, 0 AS head_at, most * CASE WHEN stream % 4 = 0 THEN 1 ELSE 4 END // 10 AS head_size, most * 6 // 10 AS tail_at, most - most * 6 // 10 AS tail_size, most * CASE WHEN stream % 11 = 0 THEN 1000 ELSE 1 END AS size
    FROM (SELECT l_suppkey AS stream, max(l_orderkey) * 188 + 188 AS most FROM lineitem GROUP BY l_suppkey)"""


@query("agg_14_clock_duration", f"""WITH t AS ({TICKS}), s AS ({SAMPLES}), p AS (SELECT stream, pid, count(*) AS n, min(place) AS seen FROM t GROUP BY ALL),
    h AS (SELECT t.stream, t.pid, count(*) AS heads, min(t.t) AS begin FROM t JOIN s USING (stream) WHERE place < head_at + head_size GROUP BY ALL), g AS (SELECT t.stream, t.pid, count(*) AS tails, max(t.t) AS finish FROM t JOIN s USING (stream) WHERE place >= tail_at GROUP BY ALL),
    x AS (SELECT p.*, s.*, heads, tails, begin, finish, (SELECT max(place) FROM t WHERE t.stream = p.stream AND t.pid = p.pid AND t.t = begin AND place < head_at + head_size) AS first_at, (SELECT max(place) FROM t WHERE t.stream = p.stream AND t.pid = p.pid AND t.t = finish AND place >= tail_at) AS last_at,
        CASE WHEN finish < begin THEN finish + 8589934592 / 90000.0 ELSE finish END - begin AS seconds FROM p JOIN h USING (stream, pid) JOIN g USING (stream, pid) JOIN s USING (stream)),
    ok AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n DESC, seen, pid) AS r FROM x WHERE heads >= 3 AND tails >= 3 AND first_at - head_at <= head_size * 0.5 AND tail_at + tail_size - last_at <= tail_size * 0.5 AND seconds > 1 AND seconds <= 43200 AND size * 8 / seconds > 32000 AND size * 8 / seconds < 40000000)
    SELECT stream, pid, round(seconds, 6) AS seconds FROM ok WHERE r = 1""")
def clock_durations(lib: Library) -> DataFrame:
    """Lines stand for clock readings of a supplier's stream, with the clock's turn in every third one."""
    t = F.expr(f"(l_orderkey / 100.0D + 95443.717D - CASE WHEN l_suppkey % 3 = 0 THEN 25 ELSE 2000 END) % {CLOCK_SECONDS!r}D")
    lines = lib.raw("lineitem").select("l_suppkey", "l_orderkey").repartition(lib.parts("lineitem"), "l_suppkey")
    ticks = lines.select(F.col("l_suppkey").alias("stream"), F.expr("CASE WHEN l_orderkey % 7 < l_suppkey % 5 THEN 257 ELSE 256 + l_orderkey % 2 * 2 END").alias("pid"), (F.col("l_orderkey") * 188).alias("at"), t.alias("t"))
    ends = lines.groupBy(F.col("l_suppkey").alias("stream")).agg((F.max("l_orderkey") * 188 + 188).alias("most"))
    samples = ends.selectExpr("stream", "0 AS head_at", "most * CASE WHEN stream % 4 = 0 THEN 1 ELSE 4 END div 10 AS head_size", "most * 6 div 10 AS tail_at", "most - most * 6 div 10 AS tail_size", "most * CASE WHEN stream % 11 = 0 THEN 1000 ELSE 1 END AS size")
    return clock_duration(ticks, samples)


@query("agg_15_distinct", "SELECT DISTINCT video_id, error_code FROM job")
def distinct(lib: Library) -> DataFrame:
    return lib.job.select("video_id", "error_code").distinct()


@query("agg_16_usage", "SELECT CASE WHEN duration IS NULL THEN 'stale' ELSE 'valid' END AS class, count(*) AS entries, CAST(sum(file_size) AS BIGINT) AS bytes FROM video GROUP BY ALL")
def usage(lib: Library) -> DataFrame:
    return lib.video.groupBy(F.when(F.col("duration").isNull(), "stale").otherwise("valid").alias("class")).agg(F.count("*").alias("entries"), F.sum("file_size").alias("bytes"))


@query("agg_17_selected_bytes", "SELECT count(*) AS files, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes FROM video WHERE id % 9 = 0")
def selected_bytes(lib: Library) -> DataFrame:
    """Copies of all groups, exploded, and the size of those selected."""
    groups = lib.video.groupBy("account_id").agg(F.collect_list(F.struct("id", "file_size")).alias("copies"))
    chosen = lib.video.where("id % 9 = 0").select("id")
    copies = groups.select(F.explode("copies").alias("c")).select("c.*").join(chosen, "id", "left_semi")
    return copies.agg(F.count("*").alias("files"), F.sum(F.coalesce("file_size", F.lit(0))).alias("bytes"))
