"""Scans, derived tables and sinks as set logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import to_bool, to_utc
from shelfwise.operators.scope import paged
from shelfwise.operators.sinks import insert_new, set_where, upsert_latest, without
from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.keyed import KeyedFiles
from shelfwise.sources.media_store import scanned, write_files
from shelfwise.sources.shared import written
from shelfwise.sources.sqlite_store import read_store, write_store
from shelfwise.streaming.feeds import place


@query("src_01_table_scan", "SELECT id, title, file_size, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS pos FROM video WHERE account_id IS NULL AND file_size > 1000 ORDER BY id LIMIT 24")
def table_scan(lib: Library) -> DataFrame:
    return paged(lib.video.where("account_id IS NULL AND file_size > 1000").select("id", "title", "file_size"), [F.col("id")])


@query("src_02_raw_query", "SELECT n_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100.0 GROUP BY n_name")
def raw_query(lib: Library) -> DataFrame:
    """SQL text with bound parameters; values never become part of the text."""
    text = "SELECT n_name AS name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name"
    return lib.spark.sql(text, args={"least": 100.0}, customer=lib.raw("customer"), nation=lib.raw("nation"))


def search_table(video: DataFrame, creator: DataFrame) -> DataFrame:
    """id, title, filename, creator and alltext (the three, a line each; a missing one is empty)."""
    names = creator.select(F.col("id").alias("creator_id"), F.col("name").alias("creator"))
    rows = video.join(names, "creator_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "filename", "creator")})
    return rows.withColumn("alltext", F.concat_ws("\n", "title", "filename", "creator"))


SEARCH_TABLE = """SELECT v.id, coalesce(v.title, '') || chr(10) || coalesce(v.filename, '') || chr(10) || coalesce(c.name, '') AS alltext
    FROM video v LEFT JOIN creator c ON c.id = v.creator_id"""


@query("src_03_search_table", SEARCH_TABLE)
def derived_search_table(lib: Library) -> DataFrame:
    return search_table(lib.video, lib.creator).select("id", "alltext")


def stored_search_table(rows: DataFrame, buckets: int = 16) -> KeyedFiles:
    """The search table (id, alltext) as files by id."""
    table = KeyedFiles(rows.sparkSession, place(rows.sparkSession, "search"), "id long, alltext string", ["id"], buckets)
    table.change(rows, lambda old, new: old.unionByName(new))
    return table


def refresh_search_table(table: KeyedFiles, video: DataFrame, creator: DataFrame, changed_video: DataFrame, changed_creator: DataFrame) -> None:
    """Rows of changed videos, and of videos of changed creators, are made anew, and those of deleted videos go; only their buckets are written."""
    touched = changed_video.select("id").union(video.join(changed_creator.select(F.col("id").alias("creator_id")), "creator_id", "left_semi").select("id")).distinct()
    fresh = search_table(video.join(touched, "id", "left_semi"), creator).select("id", "alltext")
    changes = written(touched.join(fresh, "id", "left"), "search-changes")
    table.change(changes, lambda old, new: old.join(new, "id", "left_anti").unionByName(new.where("alltext IS NOT NULL")))


@query("src_04_search_table_refresh", """WITH c2 AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed ' || name ELSE name END AS name FROM creator WHERE id % 10 <> 7),
    v2 AS (SELECT id, CASE WHEN id % 29 = 0 THEN 'edited' ELSE title END AS title, filename, creator_id FROM video WHERE id % 31 <> 0)
    SELECT v.id, coalesce(v.title, '') || chr(10) || coalesce(v.filename, '') || chr(10) || coalesce(c.name, '') AS alltext FROM v2 v LEFT JOIN c2 c ON c.id = v.creator_id""")
def refresh(lib: Library) -> DataFrame:
    video = lib.video.where("id % 31 <> 0").withColumn("title", F.expr("CASE WHEN id % 29 = 0 THEN 'edited' ELSE title END"))
    creator = lib.creator.where("id % 10 <> 7").withColumn("name", F.expr("CASE WHEN id % 3 = 0 THEN concat('renamed ', name) ELSE name END"))
    table = stored_search_table(derived_search_table(lib))
    refresh_search_table(table, video, creator, lib.video.where("id % 31 = 0 OR id % 29 = 0"), lib.creator.where("id % 3 = 0 OR id % 10 = 7"))
    return table.read()


@query("src_05_snapshot_scan", "SELECT node_id, name, size, make_timestamp(ts * 1000000) AS modified_at FROM remote WHERE coalesce(parent, '') <> 'trash'")
def snapshot(lib: Library) -> DataFrame:
    """Files of a remote snapshot with decoded times; what lies in the bin is left out."""
    return lib.remote.where("coalesce(parent, '') <> 'trash'").select("node_id", "name", "size", F.timestamp_seconds("ts").cast("timestamp_ntz").alias("modified_at"))


@query("src_06_store_scan", """SELECT CASE WHEN p_size % 5 = 0 THEN 'temp' WHEN p_partkey % 4 = 0 OR p_size = 1 THEN 'stale' ELSE 'valid' END AS class, count(*) AS entries, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY ALL""")
def store_scan(lib: Library) -> DataFrame:
    """A listing of cache files joined with its sidecars (JSON), and what each entry is worth."""
    listing = lib.raw("part").select("p_partkey", "p_size", F.to_json(F.struct((F.col("p_partkey") % 4 != 0).alias("ready"), F.col("p_size").alias("size"))).alias("sidecar"))
    said = listing.withColumn("s", F.from_json("sidecar", "ready boolean, size int"))
    kind = F.when(F.col("p_size") % 5 == 0, "temp").when(~F.col("s.ready") | (F.col("s.size") == 1), "stale").otherwise("valid")
    return said.groupBy(kind.alias("class")).agg(F.count("*").alias("entries"), F.sum("p_size").alias("bytes"))


def store_files(lib: Library) -> DataFrame:
    """name, value: files of a store, one for each supplier, with sidecars that are right, wrong, broken, of another type or missing; every fifth file is not finished."""
    rows = lib.raw("supplier").select(F.col("s_suppkey").alias("id"), F.expr("repeat('x', CAST(s_suppkey % 90 AS INT))").alias("value"))
    name = F.expr("CASE WHEN id % 5 = 0 THEN concat(id, element_at(array('.ts.part', '.live.spool', '.part.mp4'), CAST(id div 5 % 3 AS INT) + 1)) WHEN id % 13 = 0 THEN concat(id, '.txt') ELSE concat(id, '.mp4') END")
    said = F.expr("""CASE id % 7 WHEN 1 THEN concat('{"megaNodeId": "n', id, '", "outputSize": ', id % 90 + 2, '}') WHEN 2 THEN concat('{"megaNodeId": ', id, ', "outputSize": ', id % 90 + 1, '}')
        WHEN 3 THEN concat('{"megaNodeId": "n', id, '", "outputSize": ') WHEN 4 THEN NULL ELSE concat('{"megaNodeId": "n', id, '", "outputSize": ', id % 90 + 1, ', "lastAccessedAt": "2026-01-01T00:00:00Z"}') END""")
    beside = rows.select(F.concat("id", F.lit(".json")).alias("name"), said.alias("value")).where("value IS NOT NULL")
    return rows.select(name.alias("name"), "value").unionByName(beside)


@query("src_06_store_files", """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'temp' WHEN s_suppkey % 7 IN (0, 5, 6) THEN 'valid' ELSE 'stale' END AS kind, count(*) AS entries, CAST(sum(s_suppkey % 90 + 1) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 IN (0, 5, 6)) AS accessed FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 13 <> 0 GROUP BY ALL""")
def scanned_store(lib: Library) -> DataFrame:
    """Real files, listed without being opened, and their JSON sidecars; a line's end is a byte of a file, too."""
    path, tasks = place(lib.spark, "store"), lib.parts("supplier")
    write_files(store_files(lib), path, 2 * lib.raw("supplier").count(), tasks).agg(F.sum("n")).collect()
    accessed = F.count_if(F.col("last_access") == F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return scanned(lib.spark, path, tasks).groupBy("kind").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), accessed.alias("accessed"))


TYPED = """SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS flag,
    CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) ELSE make_timestamp((1700000000 + c_custkey) * 1000000) END AS at FROM customer"""


@query("src_07_typed_etl", TYPED)
def typed_etl(lib: Library) -> DataFrame:
    """Loose source values (0/1/null flags, spaced or epoch-ms times as text) to typed columns."""
    return loose_customers(lib).select("id", "name", to_bool(F.col("flag")).alias("flag"), to_utc(F.col("at")).alias("at"))


def loose_customers(lib: Library) -> DataFrame:
    return lib.raw("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.expr("CASE c_nationkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' END").alias("flag"),
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN date_format(TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, c_custkey), 'yyyy-MM-dd HH:mm:ss') ELSE CAST((1700000000 + c_custkey) * 1000 AS STRING) END").alias("at"),
    )


@query("src_07_foreign_store", f"SELECT * FROM ({TYPED}) WHERE flag IS NOT NULL AND id > 20")
def foreign_store(lib: Library) -> DataFrame:
    """The same rows by way of a folder of SQLite files, read by key ranges; both filters are answered there. Files have ranges of keys of their own, so that tasks grow with the rows and not with files times ranges."""
    path = place(lib.spark, "sqlite")
    write_store(loose_customers(lib).repartitionByRange(lib.parts("customer"), "id"), path, "Customer").agg(F.sum("n")).collect()
    rows = read_store(lib.spark, path, "Customer", "id", "id long, name string, flag string, at string").where("flag IS NOT NULL AND id > 20")
    return rows.select("id", "name", to_bool(F.col("flag")).alias("flag"), to_utc(F.col("at")).alias("at"))


@query("snk_01_insert_skip_duplicates", """SELECT id, 'old' AS origin FROM job WHERE id % 3 = 0 UNION ALL SELECT id, 'new' FROM job WHERE id % 2 = 0 AND id % 3 <> 0""")
def insert_skip(lib: Library) -> DataFrame:
    old = lib.job.where("id % 3 = 0").select("id", F.lit("old").alias("origin"))
    return insert_new(old, lib.job.where("id % 2 = 0").select("id", F.lit("new").alias("origin")), ["id"])


@query("snk_02_idempotent_insert", """SELECT v.video_id, w.video_id IS NULL AS created FROM (SELECT DISTINCT video_id FROM history WHERE user_id = 1) v LEFT JOIN (SELECT video_id FROM watchlist WHERE user_id = 1) w USING (video_id)""")
def idempotent_insert(lib: Library) -> DataFrame:
    """Adding all watched videos to the watchlist twice over: only those not there are created."""
    asked = lib.history.where("user_id = 1").select("video_id").distinct()
    there = lib.watchlist.where("user_id = 1").select("video_id", F.lit(True).alias("there"))
    return asked.join(there, "video_id", "left").select("video_id", F.col("there").isNull().alias("created"))


@query("snk_03_upsert", "SELECT user_id, video_id, max(ts) AS ts FROM (SELECT user_id, video_id, ts FROM history UNION ALL SELECT user_id, video_id, ts FROM watchlist) GROUP BY ALL")
def upsert(lib: Library) -> DataFrame:
    return upsert_latest(lib.history, lib.watchlist, ["user_id", "video_id"], "ts")


@query("snk_04_conditional_update", """SELECT id, CASE WHEN status = 'SYNCED' AND failures = 0 THEN 'SYNCING' ELSE status END AS status FROM account""")
def conditional_update(lib: Library) -> DataFrame:
    return set_where(lib.account.select("id", "status", "failures"), F.expr("status = 'SYNCED' AND failures = 0"), {"status": F.lit("SYNCING")}).drop("failures")


@query("snk_04_fill_if_null", "SELECT id, coalesce(duration, file_size % 90) AS duration FROM video")
def fill_if_null(lib: Library) -> DataFrame:
    return set_where(lib.video.select("id", "duration", "file_size"), F.col("duration").isNull(), {"duration": F.col("file_size") % 90}).drop("file_size")


@query("snk_05_scoped_delete", "SELECT user_id, video_id FROM watchlist WHERE NOT (user_id = 2 AND video_id IN (SELECT video_id FROM history WHERE user_id = 2))")
def scoped_delete(lib: Library) -> DataFrame:
    return without(lib.watchlist.select("user_id", "video_id"), lib.history.where("user_id = 2"), ["user_id", "video_id"])


@query("snk_06_delete_and_reparent", "SELECT user_id, video_id, CASE WHEN folder_id = 11 THEN NULL ELSE folder_id END AS folder_id FROM saved")
def delete_folder(lib: Library) -> DataFrame:
    return set_where(lib.saved.select("user_id", "video_id", "folder_id"), F.col("folder_id") == 11, {"folder_id": F.lit(None).cast("int")})


@query("snk_07_ndjson", """SELECT '{"type":"done","id":' || id || ',"outcome":"' || status || '"}' AS line FROM job WHERE status <> 'pending'""")
def ndjson(lib: Library) -> DataFrame:
    """One JSON object a line, as write.text() puts it."""
    return lib.job.where("status <> 'pending'").select(F.to_json(F.struct(F.lit("done").alias("type"), "id", F.col("status").alias("outcome"))).alias("line"))


@query("snk_08_atomic_publish", "SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM video")
def atomic_publish(lib: Library) -> DataFrame:
    """Written through Spark's commit protocol, then read again: all rows or none."""
    return written(lib.video.select("id"), "published").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
