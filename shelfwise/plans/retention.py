"""Which cached files have to go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.order import running_total
from shelfwise.registry import query
from shelfwise.sources.catalog import Library

def evicted(entries: DataFrame, budget: int, now: int, grace: int = 0, stale_wait: bool = False) -> DataFrame:
    """id, stale of the entries to delete: all stale ones, then the least recently used until the rest fits the budget.

    entries: id, size, last_access, stale, readers. Entries in use, and live ones within the grace time, stay; with stale_wait
    (a store whose files may still be asked for) stale ones within it stay, too. An entry goes if what remains after those
    before it is over budget. No task orders all entries.
    """
    old_enough = now - F.col("last_access") >= grace
    free = entries.where("readers = 0").where(old_enough | (F.lit(False) if stale_wait else F.col("stale")))
    total = entries.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all")).first()["all"]
    gone = free.where("stale").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("gone")).first()["gone"]
    live = running_total(free.where("NOT stale"), [F.col("last_access"), F.col("id")], F.col("size"), "upto")
    old = live.where(F.lit(total - gone) - (F.col("upto") - F.col("size")) > budget)
    return free.where("stale").select("id", "stale").unionByName(old.select("id", "stale"))


def entries(lib: Library) -> DataFrame:
    return lib.video.select("id", F.col("file_size").alias("size"), (F.col("id") * 7919 % 100003).alias("last_access"), (F.col("id") % 17 == 0).alias("stale"), F.expr("CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END").alias("readers"))


ENTRIES = "SELECT id, file_size AS size, id * 7919 % 100003 AS last_access, id % 17 = 0 AS stale, CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END AS readers FROM video"


@query("qry_25_eviction", f"""WITH e AS ({ENTRIES}), f AS (SELECT * FROM e WHERE readers = 0 AND (stale OR 100003 - last_access >= 500)),
    r AS (SELECT *, (SELECT sum(size) FROM e) - (SELECT sum(size) FROM e WHERE stale AND readers = 0) - coalesce(sum(size) FILTER (WHERE NOT stale) OVER (ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f)
    SELECT id, stale FROM r WHERE stale OR rest > 900000""")
def eviction(lib: Library) -> DataFrame:
    return evicted(entries(lib), 900_000, 100_003, 500)


@query("qry_25_media_eviction", f"""WITH e AS ({ENTRIES}), f AS (SELECT * FROM e WHERE readers = 0 AND 100003 - last_access >= 30000),
    r AS (SELECT *, (SELECT sum(size) FROM e) - coalesce((SELECT sum(size) FROM f WHERE stale), 0) - coalesce(sum(size) FILTER (WHERE NOT stale) OVER (ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f)
    SELECT id, stale FROM r WHERE stale OR rest > 900000""")
def media_eviction(lib: Library) -> DataFrame:
    """The store of whole files, where a stale one stays within the grace time."""
    return evicted(entries(lib), 900_000, 100_003, 30_000, stale_wait=True)


@query("win_08_running_budget", f"WITH e AS ({ENTRIES}), r AS (SELECT id, sum(size) OVER (ORDER BY last_access, id) AS upto FROM e WHERE NOT stale) SELECT id FROM r WHERE upto <= 500000")
def within_budget(lib: Library) -> DataFrame:
    """The oldest live entries that fit a budget together."""
    live = entries(lib).where("NOT stale")
    return running_total(live, [F.col("last_access"), F.col("id")], F.col("size"), "upto").where("upto <= 500000").select("id")
