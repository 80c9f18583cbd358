"""Projections, scopes and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.numbers import backoff
from shelfwise.functions.text import MIME, extension
from shelfwise.operators.scope import in_library, is_own, is_public, with_owner
from shelfwise.registry import query
from shelfwise.sources.catalog import NOW, Library

OWNED = "SELECT v.*, a.user_id AS owner, a.status AS owner_status FROM video v LEFT JOIN account a ON a.id = v.account_id"
VISIBLE = "account_id IS NULL OR (owner = {0} AND owner_status <> 'DISCONNECTED')"
OWN = "owner = {0} AND owner_status <> 'DISCONNECTED'"
now = lambda: F.lit(NOW).cast("timestamp_ntz")


def owned(lib: Library) -> DataFrame:
    return with_owner(lib.video, lib.account)


@query("fil_01_serialised", f"""WITH o AS ({OWNED}) SELECT o.id, o.account_id IS NOT NULL AS is_private, c.name AS creator_name, a.label AS account_label
    FROM o LEFT JOIN creator c ON c.id = o.creator_id LEFT JOIN account a ON a.id = o.account_id""")
def serialised(lib: Library) -> DataFrame:
    """Rows with their creator and account nested; shown here flat."""
    creator = lib.creator.select(F.col("id").alias("creator_id"), F.struct("id", "name").alias("creator"))
    account = lib.account.select(F.col("id").alias("account_id"), F.struct("id", "label", "status").alias("account"))
    rows = lib.video.join(creator, "creator_id", "left").join(account, "account_id", "left")
    return rows.select("id", F.col("account").isNotNull().alias("is_private"), F.col("creator.name").alias("creator_name"), F.col("account.label").alias("account_label"))


@query("fil_02_public_scope", "SELECT id FROM video WHERE account_id IS NULL")
def public_scope(lib: Library) -> DataFrame:
    return lib.video.where(is_public()).select("id")


@query("fil_03_library_scope", f"WITH o AS ({OWNED}) SELECT id, account_id FROM o WHERE {VISIBLE.format(1)}")
def library_scope(lib: Library) -> DataFrame:
    return owned(lib).where(in_library(1)).select("id", "account_id")


@query("fil_03_library_scope_anonymous", "SELECT id FROM video WHERE account_id IS NULL")
def anonymous_scope(lib: Library) -> DataFrame:
    return owned(lib).where(in_library(None)).select("id")


@query("fil_04_private_scope", f"WITH o AS ({OWNED}) SELECT id FROM o WHERE {OWN.format(2)} AND account_id = 7")
def private_scope(lib: Library) -> DataFrame:
    return owned(lib).where(is_own(2) & (F.col("account_id") == 7)).select("id")


@query("fil_05_visible_video", f"WITH o AS ({OWNED}), asked AS (SELECT unnest([13, 26, 41, 46, 21]) AS id) SELECT asked.id, bool_or(coalesce({VISIBLE.format(1)}, FALSE)) AS visible FROM asked LEFT JOIN o USING (id) GROUP BY asked.id")
def visible(lib: Library) -> DataFrame:
    asked = lib.spark.createDataFrame([(i,) for i in (13, 26, 41, 46, 21)], "id long")
    seen = owned(lib).where(in_library(1)).select("id", F.lit(True).alias("seen"))
    return asked.join(seen, "id", "left").select("id", F.col("seen").isNotNull().alias("visible"))


@query("fil_11_folder_filters", "SELECT 'all' AS kind, video_id FROM saved WHERE user_id = 1 UNION ALL SELECT 'none', video_id FROM saved WHERE user_id = 1 AND folder_id IS NULL UNION ALL SELECT 'one', video_id FROM saved WHERE user_id = 1 AND folder_id = 12")
def folder_filters(lib: Library) -> DataFrame:
    own = lib.saved.where("user_id = 1")
    kinds = {"all": F.lit(True), "none": F.col("folder_id").isNull(), "one": F.col("folder_id") == 12}
    tagged = F.filter(F.array(*[F.when(when, F.lit(kind)) for kind, when in kinds.items()]), lambda k: k.isNotNull())
    return own.select(F.explode(tagged).alias("kind"), "video_id")


DUE_SQL = """WITH a AS (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE TIMESTAMP 'NOW' - to_minutes(id * 40) END AS done_at, CASE WHEN id % 4 = 0 THEN NULL ELSE TIMESTAMP 'NOW' - to_minutes(id * 3) END AS error_at FROM account)
    SELECT id FROM a WHERE (status = 'SYNCED' AND (done_at IS NULL OR epoch(TIMESTAMP 'NOW') - epoch(done_at) >= 21600))
    OR (status = 'ERROR' AND epoch(TIMESTAMP 'NOW') - epoch(coalesce(error_at, done_at, TIMESTAMP 'NOW')) >= least(300 * pow(2, greatest(failures, 1) - 1), 21600))""".replace("NOW", NOW)


def seconds_between(later, earlier):
    return F.timestamp_diff("SECOND", earlier, later)


@query("fil_12_due_accounts", DUE_SQL)
def due_accounts(lib: Library) -> DataFrame:
    """Accounts to sync: new ones, those synced 6 h ago, and failed ones after their backoff."""
    rows = lib.account.withColumns({"done_at": F.expr(f"CASE WHEN id % 3 = 0 THEN NULL ELSE TIMESTAMP_NTZ '{NOW}' - make_dt_interval(0, 0, id * 40) END"), "error_at": F.expr(f"CASE WHEN id % 4 = 0 THEN NULL ELSE TIMESTAMP_NTZ '{NOW}' - make_dt_interval(0, 0, id * 3) END")})
    since = seconds_between(now(), F.coalesce("error_at", "done_at", now()))
    due = F.when(F.col("status") == "CONNECTED", True).when(F.col("status") == "SYNCED", F.col("done_at").isNull() | (seconds_between(now(), F.col("done_at")) >= 21600)).when(F.col("status") == "ERROR", since >= backoff(300, F.col("failures"), 21600)).otherwise(False)
    return rows.where(due).select("id")


RUNNABLE = f"""SELECT j.* FROM job j JOIN video v ON v.id = j.video_id JOIN account a ON a.id = v.account_id
    WHERE j.status = 'pending' AND j.next_retry_at <= TIMESTAMP '{{0}}' AND a.user_id <> 4 AND a.status NOT IN ('DISCONNECTED', 'REAUTH_REQUIRED')
    AND NOT EXISTS (SELECT 1 FROM job l WHERE l.status = 'generating' AND l.lease_expires_at IS NOT NULL AND l.lease_expires_at >= TIMESTAMP '{{0}}')""".replace("{{0}}", "{0}")
#: A moment at which a worker still holds a lease (the last one of the table ends a minute before NOW).
BUSY = "1998-06-16 23:50:00"


def runnable(lib: Library, moment=None) -> DataFrame:
    """Jobs that may be claimed: due, of an account in order and a user who has not paused (user 4 has); none at all while any lease lives."""
    moment = now() if moment is None else moment
    rows = lib.job.where(F.col("status").isin("pending", "queued") & (F.col("next_retry_at") <= moment))
    account = lib.account.where("user_id <> 4 AND status NOT IN ('DISCONNECTED', 'REAUTH_REQUIRED')").select(F.col("id").alias("account_id"))
    video = lib.video.select(F.col("id").alias("video_id"), "account_id").join(account, "account_id", "left_semi").select("video_id")
    leases = lib.job.where((F.col("status") == "generating") & (F.col("lease_expires_at") >= moment))
    return rows.join(video, "video_id", "left_semi").where(~leases.exists())


@query("fil_13_runnable_jobs", f"SELECT 'free' AS moment, id FROM ({RUNNABLE.format(NOW)}) UNION ALL SELECT 'busy', id FROM ({RUNNABLE.format(BUSY)})")
def runnable_jobs(lib: Library) -> DataFrame:
    """At a moment without live leases, and at one with a live lease, when there are none."""
    free, busy = runnable(lib), runnable(lib, F.lit(BUSY).cast("timestamp_ntz"))
    return free.select(F.lit("free").alias("moment"), "id").unionByName(busy.select(F.lit("busy").alias("moment"), "id"))


ENDINGS = ".MP4", ".txt", ".mkv", "", ".3g2", ".ogv", ".Ts", ".mpeg"


@query("fil_14_video_nodes", """SELECT node_id FROM (SELECT *, name || (['.MP4', '.txt', '.mkv', '', '.3g2', '.ogv', '.Ts', '.mpeg'])[ts % 8 + 1] AS file FROM remote)
    WHERE lower(regexp_extract(file, '^.+\\.([^.]+)$', 1)) IN ('mp4', 'm4v', 'mov', 'mkv', 'webm', 'avi', 'mpg', 'mpeg', 'wmv', 'flv', 'ts', '3gp', '3g2') OR (ts % 16 = 1 AND fa IS NOT NULL)""")
def video_nodes(lib: Library) -> DataFrame:
    """By extension, or by a media attribute (type 8)."""
    file = F.concat("name", F.get(F.array(*map(F.lit, ENDINGS)), (F.col("ts") % 8).cast("int")))
    rows = lib.remote.withColumns({"file": file, "fa": F.when(F.col("ts") % 16 == 1, F.concat("fa", F.lit("/2:8*m"))).otherwise(F.col("fa"))})
    return rows.where(extension(F.col("file")).isin(*MIME) | F.coalesce(F.col("fa").rlike(r"(^|/)\d+:8\*."), F.lit(False))).select("node_id")


@query("fil_15_in_list", "SELECT id, status FROM job WHERE status IN ('failed', 'unsupported') AND video_id IN (SELECT video_id FROM history WHERE user_id = 3)")
def in_list(lib: Library) -> DataFrame:
    return lib.job.where(F.col("status").isin("failed", "unsupported")).join(lib.history.where("user_id = 3").select("video_id"), "video_id", "left_semi").select("id", "status")


@query("fil_16_backlog", "SELECT id FROM video WHERE duration IS NULL AND account_id IS NOT NULL ORDER BY id LIMIT 50")
def backlog(lib: Library) -> DataFrame:
    return lib.video.where("duration IS NULL AND account_id IS NOT NULL").select("id").orderBy("id").limit(50)


@query("fil_17_keyset_page", "SELECT id, status FROM job WHERE id > 500 ORDER BY id LIMIT 100")
def keyset(lib: Library) -> DataFrame:
    return lib.job.where("id > 500").select("id", "status").orderBy("id").limit(100)
