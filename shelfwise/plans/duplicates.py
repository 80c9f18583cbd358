"""Duplicate scans and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.duplicates import groups, linked, wiped_out
from shelfwise.operators.scope import with_owner
from shelfwise.plans import twins
from shelfwise.plans.filters import OWNED
from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.shared import written


def files(lib: Library) -> DataFrame:
    """Several files of each size: sizes are rounded so that more of them agree."""
    return lib.video.select("id", "node_id", F.concat("title", F.lit(".mp4")).alias("name"), "title", F.col("file_size").alias("size"), "duration")


ITEMS = f"""items AS (SELECT id, node_id, title || '.mp4' AS name, title, CASE WHEN file_size > 0 THEN file_size END AS size, CASE WHEN duration > 0 THEN duration END AS duration, {twins.comparison_key("title || '.mp4'")} AS key FROM video),
    sized AS (SELECT * FROM items WHERE size IS NOT NULL AND length(key) >= 4),
    mates AS (SELECT least(l.id, r.id) AS a, greatest(l.id, r.id) AS b, l.key AS x, r.key AS y FROM sized l JOIN sized r ON l.size = r.size AND l.id < r.id WHERE coalesce(abs(l.duration - r.duration) <= 2, TRUE) AND (l.key = r.key OR least(length(l.key), length(r.key)) >= 8)),
    linked AS (SELECT m.a, m.b, percent AS similarity FROM mates m JOIN {twins.similarity('(SELECT x AS a, y AS b FROM mates)')} s ON s.a = m.x AND s.b = m.y WHERE percent >= 90)"""
#: A group's links are all its pairs here; the plan links neighbours only, which gives the same groups and the same least similarity.
GROUPS = f"""WITH RECURSIVE {ITEMS}, both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT DISTINCT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), proof AS (SELECT root, min(similarity) AS similarity FROM linked JOIN roots ON node = a GROUP BY root),
    members AS (SELECT root, i.* FROM items i JOIN roots ON node = id), whole AS (SELECT root, min(size) AS size, list(id ORDER BY id) AS members, count(*) AS copies, list_sort(list(duration) FILTER (WHERE duration IS NOT NULL)) AS known, string_agg(key, chr(10) ORDER BY key) AS keys, arg_min(coalesce(nullif(title, ''), name), id) AS title FROM members GROUP BY root),
    found AS (SELECT w.*, similarity, size * (copies - 1) AS savings, CASE WHEN similarity >= 95 THEN 'high' ELSE 'possible' END AS confidence, CASE WHEN coalesce(len(known), 0) = 0 THEN 'unknown' WHEN len(known) = copies AND known[-1] - known[1] <= 2 THEN 'same' ELSE 'partial-unknown' END AS duration_status FROM whole w JOIN proof USING (root) WHERE copies > 1)"""


@query("joi_10_duplicate_pairs", f"WITH RECURSIVE {ITEMS}, both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked), reach AS (SELECT DISTINCT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node) SELECT node, min(root) AS root FROM reach GROUP BY node")
def pairs(lib: Library) -> DataFrame:
    """What the links between possible duplicates bring together: each file and the least one of its group."""
    return linked(files(lib))[0].select(F.col("id").alias("node"), "root")


@query("qry_13_duplicate_groups", f"{GROUPS} SELECT root, members, copies, savings, CAST(similarity AS INTEGER) AS similarity, confidence, duration_status, known[len(known) // 2 + 1] AS duration, title FROM found")
def duplicate_groups(lib: Library) -> DataFrame:
    """Groups by their least member; the digest in group_key is checked by str_21."""
    return groups(files(lib)).select(F.get("members", F.lit(0)).alias("root"), "members", "copies", "savings", "similarity", "confidence", "duration_status", "duration", "title")


@query("agg_06_group_stats", f"{GROUPS} SELECT confidence, duration_status, count(*) AS groups, CAST(sum(copies) AS BIGINT) AS files, CAST(min(similarity) AS INTEGER) AS least FROM found GROUP BY ALL")
def group_stats(lib: Library) -> DataFrame:
    return groups(files(lib)).groupBy("confidence", "duration_status").agg(F.count("*").alias("groups"), F.sum("copies").alias("files"), F.min("similarity").alias("least"))


@query("agg_08_summary", f"{GROUPS} SELECT count(*) AS groups, CAST(coalesce(sum(copies), 0) AS BIGINT) AS files, CAST(coalesce(sum(savings), 0) AS BIGINT) AS savings, (SELECT count(*) FROM video) AS scanned FROM found")
def totals(lib: Library) -> DataFrame:
    """Totals; scanned counts all files, whatever their group."""
    found = groups(files(lib)).agg(F.count("*").alias("groups"), F.coalesce(F.sum("copies"), F.lit(0)).alias("files"), F.coalesce(F.sum("savings"), F.lit(0)).alias("savings"))
    scanned = files(lib).agg(F.count("*").alias("scanned")).withColumn("one", F.lit(1))
    return found.withColumn("one", F.lit(1)).join(F.broadcast(scanned), "one").drop("one")


@query("srt_07_groups_by_savings", f"{GROUPS} SELECT members[1] AS root, savings FROM found ORDER BY savings DESC, members[1] LIMIT 96")
def by_savings(lib: Library) -> DataFrame:
    """The top of the groups by what deleting could save; ties by their least member."""
    first = F.get("members", F.lit(0))
    return groups(files(lib)).orderBy(F.desc("savings"), first).limit(96).select(first.alias("root"), "savings")


@query("qry_14_scan_scope", f"WITH o AS ({OWNED}) SELECT id, account_id FROM o WHERE owner = 1 AND owner_status <> 'DISCONNECTED' AND file_size IS NOT NULL")
def scan_scope(lib: Library) -> DataFrame:
    return with_owner(lib.video, lib.account).where("owner = 1 AND owner_status <> 'DISCONNECTED' AND file_size IS NOT NULL").select("id", "account_id")


@query("qry_15_delete_guard", f"{GROUPS} SELECT members[1] AS root FROM found WHERE len(list_filter(members, lambda m: m % 2 = 1)) = 0")
def delete_guard(lib: Library) -> DataFrame:
    """Groups, by their least member, that a deletion of every other video would leave without any copy."""
    found = written(groups(files(lib)), "duplicate-groups")
    return wiped_out(found, lib.video.where("id % 2 = 0").select("id")).join(found, "group_key").select(F.get("members", F.lit(0)).alias("root"))


@query("qry_15_deletion_targets", "WITH asked AS (SELECT unnest(range(0, 300, 7)) AS n), mine AS (SELECT v.node_id, v.account_id FROM video v JOIN account a ON a.id = v.account_id WHERE a.user_id = 1) SELECT account_id, count(*) AS nodes FROM asked LEFT JOIN mine ON node_id = 'n' || n GROUP BY account_id")
def deletion_targets(lib: Library) -> DataFrame:
    """Asked nodes by account; those of nobody or of others under null."""
    asked = lib.spark.range(0, 300, 7).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    mine = with_owner(lib.video, lib.account).where("owner = 1").select("node_id", "account_id")
    return asked.join(mine, "node_id", "left").groupBy("account_id").agg(F.count("*").alias("nodes"))
