"""Ranking and running windows, orders, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import vtt_time
from shelfwise.operators.order import numbered
from shelfwise.operators.scope import in_library, newest, page_strips, paged, with_owner
from shelfwise.plans.filters import OWNED, RUNNABLE, VISIBLE, now, runnable
from shelfwise.registry import query
from shelfwise.sources.catalog import NOW, Library


@query("win_01_total_beside_page", "SELECT id, (SELECT count(*) FROM video WHERE account_id IS NULL) AS total FROM video WHERE account_id IS NULL ORDER BY id LIMIT 24")
def total_beside_page(lib: Library) -> DataFrame:
    """The total as a one-row aggregate joined to a page, not as a window over all rows."""
    rows = lib.video.where("account_id IS NULL")
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return rows.select("id").orderBy("id").limit(24).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("id", "total")


@query("win_02_first_n_per_source", "SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) AS r FROM video) WHERE r <= 5")
def first_n(lib: Library) -> DataFrame:
    order = Window.partitionBy("source").orderBy(*newest())
    return lib.video.withColumn("r", F.row_number().over(order)).where("r <= 5").select("source", "id")


@query("win_04_round_robin", "SELECT source, id, CAST(row_number() OVER (ORDER BY r, source) AS INTEGER) AS pos FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM video) WHERE r <= 3")
def round_robin(lib: Library) -> DataFrame:
    """Rank within the source first, then the source."""
    ranked = lib.video.select("source", "id").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("r <= 3")
    return numbered(ranked, [F.col("r"), F.col("source")]).select("source", "id", F.col("pos").cast("int").alias("pos"))


@query("win_06_keep_first_node", "SELECT video_id, min(id) AS id FROM job GROUP BY video_id")
def keep_first(lib: Library) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("id")
    return lib.job.withColumn("r", F.row_number().over(order)).where("r = 1").select("video_id", "id")


def numbered_key(base, order):
    """base for the first of equal keys, base|n for the n-th."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("|"), n.cast("string")))


@query("win_07_numbered_keys", "SELECT id, CASE WHEN n = 1 THEN k ELSE k || '|' || n END AS key FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM (SELECT id, 'possible|' || file_size AS k FROM video))")
def numbered_keys(lib: Library) -> DataFrame:
    base = F.concat(F.lit("possible|"), F.col("file_size").cast("string"))
    return lib.video.select("id", base.alias("k")).select("id", numbered_key(F.col("k"), F.col("id")).alias("key"))


@query("win_09_starvation_order", f"SELECT id, CAST(row_number() OVER (ORDER BY queued_at < TIMESTAMP '{NOW}' - INTERVAL 800 DAY DESC, priority DESC, queued_at, id) AS INTEGER) AS pos FROM ({RUNNABLE.format(NOW)}) ORDER BY pos LIMIT 24")
def starvation_order(lib: Library) -> DataFrame:
    """Jobs that waited too long go before all priorities."""
    aged = F.col("queued_at") < now() - F.expr("INTERVAL '800' DAY")
    return paged(runnable(lib), [aged.desc(), F.desc("priority"), F.col("queued_at"), F.col("id")]).select("id", "pos")


@query("win_10_cue_ends", """SELECT stream, idx, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS starts, printf('%02d:%02d:%02d.%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) AS ends
    FROM (SELECT stream, idx, start_time * 1000 AS ms, coalesce(lead(start_time * 1000) OVER (PARTITION BY stream ORDER BY idx), end_byte * 10) AS e FROM fragment)""")
def cue_ends(lib: Library) -> DataFrame:
    """A cue ends where the next begins, the last one with the stream."""
    start = F.col("start_time") * 1000
    end = F.coalesce(F.lead(start).over(Window.partitionBy("stream").orderBy("idx")), F.col("end_byte") * 10)
    return lib.fragment.select("stream", "idx", vtt_time(start).alias("starts"), vtt_time(end).alias("ends"))


#: Nearness of two starts (seconds, share of a scene), steps by which one moves on (share of a scene), and how many of them.
NEAR_SECONDS, NEAR_SHARE, STEP_SHARE, STEPS = 0.4, 0.35, 0.75, 6


def spaced_scenes(starts: Column, length: Column, least: Column, most: Column) -> Column:
    """array<double>: for each of the starts the first of its places, one step on from the next, that is not too near to those taken; else the last place."""
    near = F.greatest(F.lit(NEAR_SECONDS), NEAR_SHARE * length)

    def taken_next(taken: Column, start: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: F.least(F.greatest(start, least) + k * STEP_SHARE * length, most))
        free = F.filter(places, lambda at: ~F.exists(taken, lambda t: F.abs(t - at) < near))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.element_at(places, -1))))

    return F.aggregate(starts, F.array().cast("array<double>"), taken_next)


#: Fixed value: signatures nearer than this show the same picture.
SAME_PICTURE = 2.5


def chosen_scenes(scenes: Column) -> Column:
    """array<double> of starts in order. scenes: array of arrays of (start, bright, signature); of each the first bright one unlike those chosen, else the first."""

    def with_next(chosen: Column, options: Column) -> Column:
        fits = F.filter(options, lambda o: o["bright"] & ~F.exists(chosen, lambda c: F.abs(c["signature"] - o["signature"]) < SAME_PICTURE))
        return F.concat(chosen, F.slice(F.concat(fits, options), 1, 1))

    none = F.array().cast("array<struct<start: double, bright: boolean, signature: double>>")
    return F.array_sort(F.transform(F.aggregate(scenes, none, with_next), lambda c: c["start"]))


@query("win_11_spaced_scenes", """WITH RECURSIVE v AS (SELECT id, CAST(duration AS DOUBLE) AS d, least(duration * 0.02, 1) AS low, greatest(0.0, duration - 1.5) AS high FROM video WHERE duration > 0),
    s AS (SELECT id, 0 AS n, CAST([] AS DOUBLE[]) AS starts FROM v UNION ALL SELECT s.id, n + 1, list_append(starts, coalesce(list_filter(p.places, lambda x: len(list_filter(starts, lambda t: abs(t - x) < 0.42)) = 0)[1], p.places[7]))
        FROM s JOIN v ON v.id = s.id, LATERAL (SELECT list_transform(range(0, 7), lambda k: least(greatest(d * (0.1 + 0.2 * n), low) + k * 0.75 * 1.2, high)) AS places) p WHERE n < 5)
    SELECT id, list_transform(starts, lambda x: round(x, 6)) AS starts FROM s WHERE n = 5""")
def spaced(lib: Library) -> DataFrame:
    """Up to five scenes a video."""
    d = F.col("duration").cast("double")
    starts = spaced_scenes(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: d * (0.1 + 0.2 * i)), F.lit(1.2), F.least(d * 0.02, F.lit(1.0)), F.greatest(F.lit(0.0), d - 1.5))
    return lib.video.where("duration > 0").select("id", F.transform(starts, lambda x: F.round(x, 6)).alias("starts"))


@query("win_12_greedy_scenes", """WITH RECURSIVE o AS (SELECT stream, (idx - 1) // 2 AS scene, list({'start': CAST(idx AS DOUBLE), 'bright': keyframe, 'sign': first_byte / 1000.0} ORDER BY idx) AS options FROM fragment GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY scene) AS n FROM o),
    s AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS starts, CAST([] AS DOUBLE[]) AS signs FROM o UNION ALL
        SELECT stream, n, list_append(starts, c.start), list_append(signs, CAST(c.sign AS DOUBLE)) FROM (SELECT s.stream, n.n, starts, signs, coalesce(list_filter(options, lambda x: x.bright AND len(list_filter(signs, lambda g: abs(g - x.sign) < 2.5)) = 0)[1], options[1]) AS c FROM s JOIN n ON n.stream = s.stream AND n.n = s.n + 1))
    SELECT stream, list_sort(arg_max(starts, n)) AS starts FROM s GROUP BY stream""")
def greedy_scenes(lib: Library) -> DataFrame:
    """Pairs of neighbouring fragments as the alternatives of a scene."""
    option = F.struct(F.col("idx").cast("double").alias("start"), F.col("keyframe").alias("bright"), (F.col("first_byte") / 1000).alias("signature"))
    each = lib.fragment.groupBy("stream", F.floor((F.col("idx") - 1) / 2).alias("scene")).agg(F.array_sort(F.collect_list(option)).alias("options"))
    scenes = each.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("scene", "options")))["options"].alias("scenes"))
    return scenes.select("stream", chosen_scenes(F.col("scenes")).alias("starts"))


@query("srt_01_recency", "SELECT id, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS pos FROM video ORDER BY pos LIMIT 24 OFFSET 24")
def recency(lib: Library) -> DataFrame:
    return paged(lib.video, newest(), 2).select("id", "pos")


@query("srt_02_curated", "SELECT id, CAST(row_number() OVER (ORDER BY file_size % 10, id) AS INTEGER) AS pos FROM video WHERE account_id IS NULL ORDER BY pos LIMIT 24")
def curated(lib: Library) -> DataFrame:
    return paged(lib.video.where("account_id IS NULL"), [F.col("file_size") % 10, F.col("id")]).select("id", "pos")


SEED = "2024-05-01"


def shuffled(seed: str):
    """The order of a seed: a digest of seed and id, so that pages of one seed never overlap."""
    return [F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), F.col("id")]


@query("srt_03_seeded_shuffle", f"WITH o AS ({OWNED}) SELECT id, CAST(row_number() OVER (ORDER BY md5('{SEED}' || id)) AS INTEGER) AS pos FROM o WHERE {VISIBLE.format(1)} ORDER BY pos LIMIT 24 OFFSET 48")
def seeded_shuffle(lib: Library) -> DataFrame:
    return paged(with_owner(lib.video, lib.account).where(in_library(1)), shuffled(SEED), 3).select("id", "pos")


@query("srt_05_by_name", "SELECT id, CAST(row_number() OVER (ORDER BY name, id) AS INTEGER) AS pos FROM creator ORDER BY pos LIMIT 24")
def by_name(lib: Library) -> DataFrame:
    return paged(lib.creator, [F.col("name"), F.col("id")]).select("id", "pos")


@query("srt_06_flag_first", "SELECT id, CAST(row_number() OVER (ORDER BY duration IS NULL DESC, id) AS INTEGER) AS pos FROM video ORDER BY pos LIMIT 24")
def flag_first(lib: Library) -> DataFrame:
    return paged(lib.video, [F.col("duration").isNull().desc(), F.col("id")]).select("id", "pos")


@query("srt_08_page_clamp", "SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS pos FROM video ORDER BY id LIMIT 96")
def page_clamp(lib: Library) -> DataFrame:
    """Page 0 is page 1, and no page has more than 96 rows."""
    return paged(lib.video, [F.col("id")], 0, 5000).select("id", "pos")


@query("srt_10_seeded_permutation", f"SELECT id, row_number() OVER (ORDER BY md5('{SEED}' || id), id) AS pos FROM video WHERE account_id IS NULL")
def seeded_permutation(lib: Library) -> DataFrame:
    """A place for every public row in the order of a seed; one seed gives one order, whichever page is read."""
    return numbered(lib.video.where("account_id IS NULL").select("id"), shuffled(SEED)).select("id", "pos")


@query("srt_11_brightest", "SELECT l_orderkey AS stream, arg_max(l_linenumber, l_quantity * 100 - l_linenumber) FILTER (WHERE l_linenumber % 5 <> 4) AS frame, coalesce(max(l_quantity) FILTER (WHERE l_linenumber % 5 <> 4) >= 45, FALSE) AS usable FROM lineitem GROUP BY l_orderkey")
def brightest(lib: Library) -> DataFrame:
    """The brightest frame (of equals the first) that could be read, whether it clears the floor or is the best there is."""
    rows = lib.raw("lineitem").withColumn("bright", F.when(F.col("l_linenumber") % 5 != 4, F.col("l_quantity")))
    return rows.groupBy(F.col("l_orderkey").alias("stream")).agg(F.max_by("l_linenumber", F.col("bright") * 100 - F.col("l_linenumber")).alias("frame"), F.coalesce(F.max("bright") >= 45, F.lit(False)).alias("usable"))


@query("srt_12_page_strip", """WITH c AS (SELECT c.id, greatest(1, CAST(ceil(count(v.id) / 3.0) AS BIGINT)) AS pages FROM creator c LEFT JOIN video v ON v.creator_id = c.id GROUP BY c.id), a AS (SELECT *, id % pages + 1 AS page FROM c),
    p AS (SELECT id, page, pages, unnest(range(1, pages + 1)) AS number FROM a), k AS (SELECT * FROM p WHERE pages <= 7 OR number IN (1, pages) OR abs(number - page) <= 1),
    g AS (SELECT id, number, number - lag(number) OVER (PARTITION BY id ORDER BY number) > 1 AS gap FROM k), e AS (SELECT id, number, number AS page FROM g UNION ALL SELECT id, number - 0.5, NULL FROM g WHERE gap)
    SELECT id, CAST(page AS BIGINT) AS page, row_number() OVER (PARTITION BY id ORDER BY number) - 1 AS pos FROM e""")
def strip(lib: Library) -> DataFrame:
    """The strip below every creator's listing, at some page of it; null is a gap."""
    counts = lib.video.groupBy(F.col("creator_id").alias("id")).agg(F.count("*").alias("n"))
    pages = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / 3))
    at = lib.creator.join(counts, "id", "left").select("id", pages.alias("pages")).withColumn("page", F.col("id") % F.col("pages") + 1)
    return at.select("id", F.posexplode(page_strips(F.col("page"), F.col("pages"))).alias("pos", "page")).select("id", "page", F.col("pos").cast("long").alias("pos"))


@query("set_01_exclusion", "SELECT video_id FROM watchlist WHERE user_id = 1 AND video_id NOT IN (SELECT video_id FROM history WHERE user_id = 1)")
def exclusion(lib: Library) -> DataFrame:
    return lib.watchlist.where("user_id = 1").join(lib.history.where("user_id = 1").select("video_id"), "video_id", "left_anti").select("video_id")


def chained(parts: list[DataFrame], key: str) -> DataFrame:
    """Ordered union that keeps the first of equal keys; every part has pos."""
    rows = parts[0].withColumn("part", F.lit(0))
    for i, more in enumerate(parts[1:], 1):
        rows = rows.unionByName(more.withColumn("part", F.lit(i)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("part", "pos"))
    return rows.withColumn("r", first).where("r = 1").drop("r")


@query("set_02_ordered_union", """WITH p AS (SELECT 0 AS part, video_id AS id, row_number() OVER (ORDER BY ts DESC, video_id) AS pos FROM history WHERE user_id = 1 UNION ALL SELECT 1, video_id, row_number() OVER (ORDER BY ts DESC, video_id) FROM watchlist WHERE user_id = 1)
    SELECT id, min(part) AS part FROM p GROUP BY id""")
def ordered_union(lib: Library) -> DataFrame:
    part = lambda t: numbered(t.where("user_id = 1").select(F.col("video_id").alias("id"), "ts"), [F.desc("ts"), F.col("id")]).drop("ts")
    return chained([part(lib.history), part(lib.watchlist)], "id").select("id", "part")


@query("set_03_fallback_fill", """WITH same AS (SELECT id, file_size FROM video WHERE account_id IS NULL AND source = 'src0' AND id <> 0 ORDER BY file_size % 10, id LIMIT 12),
    rest AS (SELECT id, file_size FROM video WHERE account_id IS NULL AND id <> 0 AND id NOT IN (SELECT id FROM same) ORDER BY file_size % 10, id LIMIT (SELECT 12 - count(*) FROM same)) SELECT id FROM same UNION ALL SELECT id FROM rest""")
def fallback_fill(lib: Library) -> DataFrame:
    """Public recommendations: the same creator's first, others to fill up."""
    public = lib.video.where("account_id IS NULL AND id <> 0")
    order = [F.when(F.col("source") == "src0", 0).otherwise(1), F.col("file_size") % 10, F.col("id")]
    return public.orderBy(*order).limit(12).select("id")
