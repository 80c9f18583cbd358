"""Listings of videos, lists, folders and creators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.scope import in_library, is_own, newest, paged, with_owner
from shelfwise.plans.filters import OWN, OWNED, VISIBLE
from shelfwise.plans.windows import SEED, shuffled
from shelfwise.registry import query
from shelfwise.sources.catalog import Library

POS = "CAST(row_number() OVER (ORDER BY {0}) AS INTEGER) AS pos"


@query("qry_03_random_page", f"WITH o AS ({OWNED}) SELECT id, {POS.format(f'md5({SEED!r} || id)')}, (SELECT count(*) FROM o WHERE {VISIBLE.format(2)}) AS total FROM o WHERE {VISIBLE.format(2)} ORDER BY pos LIMIT 24")
def random_page(lib: Library) -> DataFrame:
    rows = with_owner(lib.video, lib.account).where(in_library(2))
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return paged(rows, shuffled(SEED)).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("id", "pos", "total")


@query("qry_04_public_list", f"SELECT id, {POS.format('file_size % 10, id')} FROM video WHERE account_id IS NULL ORDER BY pos LIMIT 24")
def public_list(lib: Library) -> DataFrame:
    return paged(lib.video.where("account_id IS NULL"), [F.col("file_size") % 10, F.col("id")]).select("id", "pos")


@query("qry_05_creator_page", f"WITH o AS ({OWNED}) SELECT o.id, {POS.format('created_at DESC, o.id DESC')} FROM o JOIN creator c ON c.id = o.creator_id WHERE c.user_id = 1 AND c.name = 'src11' AND {OWN.format(1)} ORDER BY pos LIMIT 24")
def creator_page(lib: Library) -> DataFrame:
    creator = lib.creator.where("user_id = 1 AND name = 'src11'").select(F.col("id").alias("creator_id"))
    return paged(with_owner(lib.video, lib.account).where(is_own(1)).join(creator, "creator_id", "left_semi"), newest()).select("id", "pos")


@query("qry_05_creators", "SELECT c.id, c.name, count(v.id) AS videos FROM creator c LEFT JOIN video v ON v.creator_id = c.id WHERE c.user_id = 1 GROUP BY ALL")
def creators(lib: Library) -> DataFrame:
    """All assigned videos count, visible or not."""
    counts = lib.video.where("creator_id IS NOT NULL").groupBy("creator_id").agg(F.count("*").alias("n"))
    rows = lib.creator.where("user_id = 1").join(counts, F.col("id") == F.col("creator_id"), "left")
    return rows.select("id", "name", F.coalesce("n", F.lit(0)).alias("videos"))


@query("qry_07_private_library", f"WITH o AS ({OWNED}) SELECT id, {POS.format('created_at DESC, id DESC')} FROM o WHERE {OWN.format(3)} ORDER BY pos LIMIT 24 OFFSET 24")
def private_library(lib: Library) -> DataFrame:
    return paged(with_owner(lib.video, lib.account).where(is_own(3)), newest(), 2).select("id", "pos")


@query("qry_07_count", f"WITH o AS ({OWNED}) SELECT owner AS user_id, count(*) AS n FROM o WHERE owner_status <> 'DISCONNECTED' GROUP BY owner")
def counts(lib: Library) -> DataFrame:
    """Private videos of every user at once."""
    return with_owner(lib.video, lib.account).where("owner_status <> 'DISCONNECTED'").groupBy(F.col("owner").alias("user_id")).agg(F.count("*").alias("n"))


def listed(items: DataFrame, video: DataFrame, user: int, page: int = 1) -> DataFrame:
    """A page of a user's list, latest first; what was visible when it was added stays listed."""
    rows = items.where(F.col("user_id") == user).join(video.select(F.col("id").alias("video_id"), "title"), "video_id")
    return paged(rows, [F.desc("ts"), F.col("video_id")], page).select("video_id", "title", "pos")


LISTED = "SELECT x.video_id, v.title, " + POS.format("ts DESC, x.video_id") + " FROM {0} x JOIN video v ON v.id = x.video_id WHERE x.user_id = {1} ORDER BY pos LIMIT 24"


@query("qry_08_watchlist", LISTED.format("watchlist", 2))
def watchlist(lib: Library) -> DataFrame:
    return listed(lib.watchlist, lib.video, 2)


@query("qry_08_saved", LISTED.format("saved", 2))
def saved(lib: Library) -> DataFrame:
    return listed(lib.saved, lib.video, 2)


@query("qry_08_history", LISTED.format("history", 2))
def history(lib: Library) -> DataFrame:
    return listed(lib.history, lib.video, 2)


@query("qry_08_folders", "SELECT f.id, f.name, count(s.video_id) AS videos FROM folder f LEFT JOIN saved s ON s.folder_id = f.id AND s.user_id = f.user_id WHERE f.user_id = 1 GROUP BY ALL")
def folders(lib: Library) -> DataFrame:
    counts = lib.saved.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n"))
    return lib.folder.where("user_id = 1").join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("videos"))


@query("qry_08_recent_refs", "SELECT user_id, video_id, r AS pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, video_id) AS INTEGER) AS r FROM history) WHERE r <= 5")
def recent_refs(lib: Library) -> DataFrame:
    """The last five of every user's history, in one pass."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "video_id")
    return lib.history.withColumn("pos", F.row_number().over(order)).where("pos <= 5").select("user_id", "video_id", "pos")
