"""Joins of every kind that the library's queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.reconcile import plan_changes
from shelfwise.operators.scope import in_library, newest, paged, with_owner
from shelfwise.operators.timeline import asof
from shelfwise.plans.filters import OWNED, VISIBLE, now
from shelfwise.registry import query
from shelfwise.sources.catalog import NOW, Library


@query("joi_01_outer_dimensions", "SELECT v.id, c.name AS creator, a.label FROM video v LEFT JOIN creator c ON c.id = v.creator_id LEFT JOIN account a ON a.id = v.account_id")
def outer_dimensions(lib: Library) -> DataFrame:
    creator, account = lib.creator.select(F.col("id").alias("creator_id"), F.col("name").alias("creator")), lib.account.select(F.col("id").alias("account_id"), "label")
    return lib.video.join(creator, "creator_id", "left").join(account, "account_id", "left").select("id", "creator", "label")


@query("joi_02_semi_scope", "SELECT id FROM video WHERE account_id IN (SELECT id FROM account WHERE user_id = 3 AND status <> 'DISCONNECTED')")
def semi_scope(lib: Library) -> DataFrame:
    own = lib.account.where("user_id = 3 AND status <> 'DISCONNECTED'").select(F.col("id").alias("account_id"))
    return lib.video.join(own, "account_id", "left_semi").select("id")


@query("joi_03_existence_columns", "SELECT v.id, contains(lower(v.title), 'the') AS a, coalesce(contains(lower(c.name), 'src1'), FALSE) AS b FROM video v LEFT JOIN creator c ON c.id = v.creator_id")
def existence_columns(lib: Library) -> DataFrame:
    """Every existence test of a query as a column over one join, instead of one join for each test."""
    creator = lib.creator.select(F.col("id").alias("creator_id"), F.col("name").alias("creator"))
    return lib.video.join(creator, "creator_id", "left").select("id", F.contains(F.lower("title"), F.lit("the")).alias("a"), F.coalesce(F.contains(F.lower("creator"), F.lit("src1")), F.lit(False)).alias("b"))


@query("joi_04_ordered_page", f"WITH o AS ({OWNED}) SELECT id, title, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS INTEGER) AS pos FROM o WHERE {VISIBLE.format(0)} ORDER BY created_at DESC, id DESC LIMIT 24")
def ordered_page(lib: Library) -> DataFrame:
    """Order and columns in one plan: no second lookup by id."""
    return paged(with_owner(lib.video, lib.account).where(in_library(0)), newest()).select("id", "title", "pos")


@query("joi_05_list_items", "SELECT w.user_id, w.video_id, v.title FROM watchlist w JOIN video v ON v.id = w.video_id")
def list_items(lib: Library) -> DataFrame:
    return lib.watchlist.join(lib.video.select(F.col("id").alias("video_id"), "title"), "video_id").select("user_id", "video_id", "title")


@query("joi_06_claim_chain", "SELECT j.id, a.user_id, a.label FROM job j JOIN video v ON v.id = j.video_id JOIN account a ON a.id = v.account_id JOIN region r ON r.r_regionkey = a.user_id WHERE j.priority = 1")
def claim_chain(lib: Library) -> DataFrame:
    video = lib.video.select(F.col("id").alias("video_id"), "account_id")
    account = lib.account.select(F.col("id").alias("account_id"), "user_id", "label")
    user = lib.raw("region").select(F.col("r_regionkey").alias("user_id"))
    return lib.job.where("priority = 1").join(video, "video_id").join(account, "account_id").join(user, "user_id").select("id", "user_id", "label")


@query("joi_07_no_live_lease", f"SELECT id FROM job WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM job WHERE status = 'generating' AND lease_expires_at >= TIMESTAMP '2100-01-01') UNION ALL SELECT id FROM job WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM job WHERE status = 'generating' AND lease_expires_at >= TIMESTAMP '{NOW}')")
def no_live_lease(lib: Library) -> DataFrame:
    """A condition of one value for all rows: whether a live lease exists."""

    def unless(rows: DataFrame, moment) -> DataFrame:
        live = lib.job.where((F.col("status") == "generating") & (F.col("lease_expires_at") >= moment))
        return rows.where(~live.exists()).select("id")

    return unless(lib.job.where("status = 'pending'"), F.lit("2100-01-01").cast("timestamp_ntz")).union(unless(lib.job.where("status = 'failed'"), now()))


@query("joi_08_reconcile_outer", "SELECT coalesce(r.node_id, e.node_id) AS node_id, r.node_id IS NULL AS gone, e.node_id IS NULL AS new FROM remote r FULL JOIN existing e ON r.node_id = e.node_id")
def reconcile_outer(lib: Library) -> DataFrame:
    return plan_changes(lib.remote, lib.existing).select("node_id", (F.col("action") == "remove").alias("gone"), (F.col("action") == "add").alias("new"))


KEY = "concat(v.id, ':hover:', coalesce(v.node_id, 'missing'), ':', coalesce(CAST(v.file_size AS VARCHAR), 'unknown'), ':v1')"


def job_key(video: DataFrame, version: str = "v1"):
    return F.concat_ws(":", F.col("id").cast("string"), F.lit("hover"), F.coalesce("node_id", F.lit("missing")), F.coalesce(F.col("file_size").cast("string"), F.lit("unknown")), F.lit(version))


@query("joi_09_computed_key", f"SELECT v.id, j.status FROM video v LEFT JOIN (SELECT video_id || ':hover:n' || video_id || ':' || d.file_size || ':v1' AS key, min(status) AS status FROM job JOIN video d ON d.id = video_id GROUP BY ALL) j ON j.key = {KEY}")
def computed_key(lib: Library) -> DataFrame:
    keyed = lib.video.select("id", job_key(lib.video).alias("key"))
    jobs = lib.job.groupBy(F.col("video_id").alias("id")).agg(F.min("status").alias("status")).join(keyed, "id").select("key", "status")
    return keyed.join(jobs, "key", "left").select("id", "status")


@query("joi_11_owned_or_unknown", "WITH asked AS (SELECT unnest(range(0, 400, 7)) AS n), mine AS (SELECT v.node_id, v.account_id FROM video v JOIN account a ON a.id = v.account_id WHERE a.user_id = 1) SELECT 'n' || n AS node_id, m.account_id, m.node_id IS NULL AS unknown FROM asked LEFT JOIN mine m ON m.node_id = 'n' || n")
def owned_or_unknown(lib: Library) -> DataFrame:
    asked = lib.spark.range(0, 400, 7).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    mine = with_owner(lib.video, lib.account).where("owner = 1").select("node_id", "account_id", F.lit(True).alias("known"))
    return asked.join(mine, "node_id", "left").select("node_id", "account_id", F.col("known").isNull().alias("unknown"))


def moments(lib: Library, last: str = "start_time") -> DataFrame:
    """Points to look up in each stream, before the first fragment and after the last among them."""
    each = lib.fragment.groupBy("stream").agg(F.max(last).alias("top"))
    return each.select("stream", F.explode(F.array(F.lit(-5).cast("long"), F.lit(3).cast("long"), F.col("top").cast("long"), F.expr("top div 2"), F.col("top") + 1000)).alias("at"))


MOMENTS = "SELECT stream, unnest([-5, 3, max({0}), max({0}) // 2, max({0}) + 1000]) AS at FROM fragment GROUP BY stream"


@query("joi_12_asof_time", f"WITH m AS ({MOMENTS.format('start_time')}) SELECT m.stream, m.at, (SELECT max(f.idx) FROM fragment f WHERE f.stream = m.stream AND f.start_time <= m.at) AS idx FROM m")
def asof_time(lib: Library) -> DataFrame:
    return asof(moments(lib), lib.fragment.withColumn("at", F.col("start_time")), ["stream"], "at", ["idx"], parts=lib.parts("lineitem"))


@query("joi_13_byte_to_fragment", f"WITH m AS ({MOMENTS.format('first_byte')}) SELECT m.stream, m.at, (SELECT max(f.idx) FROM fragment f WHERE f.stream = m.stream AND f.first_byte <= m.at) AS idx, coalesce((SELECT max(f.end_byte) FROM fragment f WHERE f.stream = m.stream AND f.first_byte <= m.at) > m.at, FALSE) AS inside FROM m")
def byte_to_fragment(lib: Library) -> DataFrame:
    """The fragment that holds a byte, or the one before it."""
    found = asof(moments(lib, "first_byte"), lib.fragment.withColumn("at", F.col("first_byte")), ["stream"], "at", ["idx", "end_byte"], parts=lib.parts("lineitem"))
    return found.select("stream", "at", "idx", F.coalesce(F.col("end_byte") > F.col("at"), F.lit(False)).alias("inside"))


@query("joi_14_keyframe_and_next", f"WITH m AS ({MOMENTS.format('start_time')}) SELECT m.stream, m.at, (SELECT max(f.idx) FROM fragment f WHERE f.stream = m.stream AND f.keyframe AND f.start_time <= m.at) AS keyframe, (SELECT min(f.idx) FROM fragment f WHERE f.stream = m.stream AND f.start_time >= m.at) AS next FROM m")
def keyframe_and_next(lib: Library) -> DataFrame:
    series = lib.fragment.withColumn("at", F.col("start_time"))
    keys = series.where("keyframe").withColumn("key", F.col("idx"))
    found = asof(moments(lib), keys, ["stream"], "at", ["key"], parts=lib.parts("lineitem"))
    return asof(found, series, ["stream"], "at", ["idx"], forward=True, parts=lib.parts("lineitem")).select("stream", "at", F.col("key").alias("keyframe"), F.col("idx").alias("next"))


@query("joi_15_ownership_backfill", "SELECT c.id, b.owner FROM creator c LEFT JOIN (SELECT creator_id, min(user_id) AS owner FROM video v JOIN account a ON a.id = v.account_id GROUP BY ALL) b ON b.creator_id = c.id")
def ownership_backfill(lib: Library) -> DataFrame:
    """One owner for each creator: the least, so that it is always the same."""
    owner = with_owner(lib.video, lib.account).where("creator_id IS NOT NULL").groupBy("creator_id").agg(F.min("owner").alias("owner"))
    return lib.creator.select(F.col("id").alias("creator_id")).join(owner, "creator_id", "left").select(F.col("creator_id").alias("id"), "owner")


@query("joi_16_prioritised_lookup", "SELECT c.c_custkey AS id, CASE WHEN c.c_custkey % 5 = 0 AND s.s_suppkey IS NOT NULL THEN NULL ELSE coalesce(n.n_name, s.s_name) END AS found FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_custkey LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def prioritised_lookup(lib: Library) -> DataFrame:
    """By link first, by address otherwise; a conflict gives nobody."""
    link = lib.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("by_link"))
    mail = lib.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("by_mail"))
    rows = lib.raw("customer").select(F.col("c_custkey").alias("id")).join(link, "id", "left").join(mail, "id", "left")
    conflict = (F.col("id") % 5 == 0) & F.col("by_mail").isNotNull()
    return rows.select("id", F.when(~conflict, F.coalesce("by_link", "by_mail")).alias("found"))


def sample_offsets(sizes: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """stream, sample, at: where each sample of a file begins.

    sizes: stream, sample (from 0), size. chunks: stream, chunk (from 1), offset. runs: stream, chunk, samples: from this chunk on each holds so many.
    A chunk takes the last run at or before it, a sample the chunk that its number falls into. Streams whose chunks hold other than their samples are left out.
    """
    held = asof(chunks.withColumn("at", F.col("chunk")), runs.withColumn("at", F.col("chunk")).select("stream", "at", "samples"), ["stream"], "at", ["samples"]).drop("at")
    upto = F.sum("samples").over(Window.partitionBy("stream").orderBy("chunk"))
    held = held.withColumn("first", upto - F.col("samples"))
    total = held.groupBy("stream").agg(F.sum("samples").alias("held"), F.count_if(F.col("samples").isNull()).alias("none"))
    whole = sizes.groupBy("stream").agg(F.count("*").alias("n")).join(total, "stream").where("n = held AND none = 0").select("stream")
    rows = asof(sizes.join(whole, "stream", "left_semi").withColumn("at", F.col("sample")), held.where("samples > 0").withColumn("at", F.col("first")).select("stream", "at", "chunk", "offset"), ["stream"], "at", ["chunk", "offset"])
    before = F.sum("size").over(Window.partitionBy("stream", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("stream", "sample", (F.col("offset") + F.coalesce(before, F.lit(0))).alias("at"))


RUNS = "SELECT stream, unnest([1, 4, 6]) AS chunk, unnest([2 + stream % 3, 1, 1]) AS samples FROM (SELECT DISTINCT l_suppkey AS stream FROM lineitem)"


@query("mat_14_sample_offsets", f"""WITH s AS (SELECT l_suppkey AS stream, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS sample, CAST(l_quantity * 10 AS BIGINT) AS size FROM lineitem), r AS ({RUNS}),
    n AS (SELECT stream, count(*) AS n FROM s GROUP BY stream), c AS (SELECT stream, unnest(range(1, n - 3 * (2 + stream % 3) - 2 + 5 + CASE WHEN stream % 7 = 0 THEN 2 ELSE 1 END)) AS chunk FROM n),
    h AS (SELECT c.stream, c.chunk, (SELECT arg_max(r.samples, r.chunk) FROM r WHERE r.stream = c.stream AND r.chunk <= c.chunk) AS samples FROM c), f AS (SELECT *, sum(samples) OVER (PARTITION BY stream ORDER BY chunk) - samples AS first FROM h),
    w AS (SELECT stream FROM f GROUP BY stream HAVING sum(samples) = (SELECT n FROM n WHERE n.stream = f.stream))
    SELECT s.stream, s.sample, CAST(f.chunk * 5000 + s.stream + coalesce(sum(size) OVER (PARTITION BY s.stream, f.chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at" FROM s JOIN w USING (stream) JOIN f ON f.stream = s.stream AND s.sample >= f.first AND s.sample < f.first + f.samples""")
def offsets(lib: Library) -> DataFrame:
    """The tables of a supplier's file, made of its lines; every seventh file has a chunk too many."""
    lines = lib.raw("lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    sizes = lines.select(F.col("l_suppkey").alias("stream"), (F.row_number().over(order) - 1).alias("sample"), (F.col("l_quantity") * 10).cast("long").alias("size"))
    streams = lines.groupBy(F.col("l_suppkey").alias("stream")).agg(F.count("*").alias("n"))
    runs = streams.select("stream", F.inline(F.expr("array(named_struct('chunk', 1, 'samples', 2 + stream % 3), named_struct('chunk', 4, 'samples', 1L), named_struct('chunk', 6, 'samples', 1L))")))
    chunks = streams.select("stream", F.explode(F.expr("sequence(1, CAST(n - 3 * (2 + stream % 3) - 2 + 5 + CASE WHEN stream % 7 = 0 THEN 1 ELSE 0 END AS INT))")).alias("chunk"))
    return sample_offsets(sizes, chunks.withColumn("offset", F.col("chunk").cast("long") * 5000 + F.col("stream")), runs)
