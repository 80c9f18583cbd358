"""A durable job queue as set logic over its table. Nothing here runs jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.numbers import backoff
from shelfwise.operators.scope import with_owner
from shelfwise.plans.aggregates import STATUSES, status_counts
from shelfwise.plans.filters import RUNNABLE, now, runnable
from shelfwise.plans.scalars import BLOCKED, auto_retry_blocked
from shelfwise.registry import query
from shelfwise.sources.catalog import NOW, Library

MOST_ATTEMPTS, MOST_RECOVERIES = 3, 5


def jobs_of(lib: Library, user: int) -> DataFrame:
    video = with_owner(lib.video, lib.account).where(F.col("owner") == user).select(F.col("id").alias("video_id"))
    return lib.job.join(video, "video_id", "left_semi")


def missing_jobs(video: DataFrame, job: DataFrame, moment, retry_failed: bool = True, force: bool = False) -> DataFrame:
    """id and what asking for a job does: queued already, complete, unsupported, failed (left alone), retry or create.

    job: the latest job of each video. A failed one is tried again when it is due, not blocked and has attempts left.
    """
    due = (F.coalesce("next_retry_at", moment) <= moment) & ~auto_retry_blocked() & (F.col("attempts") < MOST_ATTEMPTS)
    again = F.lit(force) | (F.lit(retry_failed) & due)
    outcome = (
        F.when(F.col("status").isNull(), "create")
        .when(F.col("status").isin("pending", "queued", "generating"), "queued")
        .when(F.col("status") == "completed", "complete")
        .when(F.col("status") == "unsupported", "retry" if force else "unsupported")
        .otherwise(F.when(again, "retry").otherwise("failed"))
    )
    return video.join(job, video["id"] == job["video_id"], "left").select(video["id"], outcome.alias("outcome"))


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id DESC) AS r FROM job) WHERE r = 1"


def latest(lib: Library) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy(F.desc("id"))
    return lib.job.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").withColumnRenamed("id", "job_id")


@query("qry_19_missing_jobs", f"""WITH l AS ({LATEST}) SELECT v.id, CASE WHEN l.id IS NULL THEN 'create' WHEN status IN ('pending', 'queued', 'generating') THEN 'queued' WHEN status = 'completed' THEN 'complete' WHEN status = 'unsupported' THEN 'unsupported'
    WHEN coalesce(next_retry_at, TIMESTAMP '{NOW}') <= TIMESTAMP '{NOW}' AND coalesce(error_code, '') NOT IN {BLOCKED} AND attempts < 3 THEN 'retry' ELSE 'failed' END AS outcome FROM video v LEFT JOIN l ON l.video_id = v.id WHERE v.account_id IS NOT NULL""")
def ensure_jobs(lib: Library) -> DataFrame:
    return missing_jobs(lib.video.where("account_id IS NOT NULL").select("id"), latest(lib), now())


@query("qry_20_claim_next", f"SELECT id, video_id, 'generating' AS status, TIMESTAMP '{NOW}' + INTERVAL 10 MINUTE AS lease_expires_at FROM ({RUNNABLE.format(NOW)}) ORDER BY queued_at < TIMESTAMP '{NOW}' - INTERVAL 800 DAY DESC, priority DESC, queued_at, id LIMIT 1")
def claim_next(lib: Library) -> DataFrame:
    """The row that a claim takes, as it is written back; a table format with transactions makes it a compare-and-set."""
    aged = F.col("queued_at") < now() - F.expr("INTERVAL '800' DAY")
    top = runnable(lib).orderBy(aged.desc(), F.desc("priority"), "queued_at", "id").limit(1)
    return top.select("id", "video_id", F.lit("generating").alias("status"), (now() + F.expr("INTERVAL '10' MINUTE")).alias("lease_expires_at"))


@query("qry_21_recovered_leases", f"""SELECT id, CASE WHEN attempts >= 3 OR recoveries + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts >= 3 THEN 'max_attempts' WHEN recoveries + 1 >= 5 THEN 'worker_recovery_exhausted' ELSE 'lease_expired' END AS error_code,
    recoveries + 1 AS recoveries, TIMESTAMP '{NOW}' + to_seconds(CAST(CASE WHEN attempts >= 3 OR recoveries + 1 >= 5 THEN 0 ELSE least(60 * pow(2, recoveries), 900) END AS BIGINT)) AS next_retry_at
    FROM job WHERE status = 'generating' AND (lease_expires_at IS NULL OR lease_expires_at < TIMESTAMP '{NOW}')""")
def recovered(lib: Library) -> DataFrame:
    """Jobs whose worker is gone go back with a backoff, or fail for good."""
    lost = lib.job.where((F.col("status") == "generating") & F.coalesce(F.col("lease_expires_at") < now(), F.lit(True)))
    spent, lame = F.col("attempts") >= MOST_ATTEMPTS, F.col("recoveries") + 1 >= MOST_RECOVERIES
    wait = F.when(spent | lame, 0).otherwise(backoff(60, F.col("recoveries") + 1, 900))
    return lost.select(
        "id", F.when(spent | lame, "failed").otherwise("pending").alias("status"), F.when(spent, "max_attempts").when(lame, "worker_recovery_exhausted").otherwise("lease_expired").alias("error_code"),
        (F.col("recoveries") + 1).alias("recoveries"), (now() + F.make_dt_interval(secs=wait)).alias("next_retry_at"),
    )


OWN_JOBS = "SELECT j.* FROM job j JOIN video v ON v.id = j.video_id JOIN account a ON a.id = v.account_id WHERE a.user_id = {0}"


@query("qry_22_library_stats", f"WITH m AS ({OWN_JOBS.format(1)}) SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + f", CAST(epoch(TIMESTAMP '{NOW}') - epoch((SELECT queued_at FROM m WHERE status IN ('pending', 'queued') ORDER BY priority DESC, queued_at LIMIT 1)) AS BIGINT) AS oldest_seconds FROM m")
def stats(lib: Library) -> DataFrame:
    """Counts by status, and the age of the oldest waiting job within the highest priority that waits."""
    waiting = F.col("status").isin("pending", "queued")
    first = F.max(F.when(waiting, F.struct("priority", (-F.unix_timestamp("queued_at")).alias("since"))))
    return jobs_of(lib, 1).agg(*status_counts(), (F.unix_timestamp(now()) + first["since"]).alias("oldest_seconds"))


@query("qry_22_failures", f"SELECT id, error_code, CAST(row_number() OVER (ORDER BY queued_at DESC, id) AS INTEGER) AS pos FROM ({OWN_JOBS.format(2)}) WHERE status IN ('failed', 'unsupported') ORDER BY pos LIMIT 20")
def failures(lib: Library) -> DataFrame:
    from shelfwise.operators.scope import paged

    return paged(jobs_of(lib, 2).where(F.col("status").isin("failed", "unsupported")), [F.desc("queued_at"), F.col("id")], 1, 20).select("id", "error_code", "pos")


@query("qry_23_retry_terminal", f"SELECT id, 'pending' AS status, 0 AS attempts FROM ({OWN_JOBS.format(3)}) WHERE status = 'failed' ORDER BY queued_at, id LIMIT 100")
def retry_terminal(lib: Library) -> DataFrame:
    """The oldest hundred failed jobs of a user, as they are written back."""
    return jobs_of(lib, 3).where("status = 'failed'").orderBy("queued_at", "id").limit(100).select("id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


#: Fixed value: what an account says whose sync was cut off.
INTERRUPTED = "Sync was interrupted by a server restart."


def recovered_syncs(account: DataFrame, moment) -> DataFrame:
    """The accounts found syncing at start-up, as they are written back: an error, one failure more, and an outcome that can be shown."""
    stuck = account.where("status = 'SYNCING'")
    return stuck.select("id", F.lit("ERROR").alias("status"), (F.col("failures") + 1).alias("failures"), F.lit(INTERRUPTED).alias("error"), moment.alias("error_at"), F.lit("interrupted").alias("outcome"))


@query("qry_24_stuck_syncs", f"SELECT id, 'ERROR' AS status, failures + 1 AS failures, '{INTERRUPTED}' AS error, TIMESTAMP '{NOW}' AS error_at, 'interrupted' AS outcome FROM account WHERE status = 'SYNCING'")
def stuck_syncs(lib: Library) -> DataFrame:
    return recovered_syncs(lib.account, now())
