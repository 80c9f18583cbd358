"""The logical tables of a media library, derived from the generic test tables.

Each table is a projection by integer arithmetic, given once as a DataFrame and once as SQL (CTE), so
that every query over them can be checked in another engine. Public rows, disconnected accounts and
NULLs are derived on purpose: the generic tables have none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of every query that needs one; never the clock.
NOW = "1998-06-17 00:00:00"
#: Rows of a generic table for one task, where Spark would take few tasks as their rows are short.
ROWS = 250_000


@dataclass
class Library:
    """Logical tables over one folder of Parquet files; each is read lazily and pruned by Catalyst."""

    spark: SparkSession
    path: str
    seen: dict[str, DataFrame] = field(default_factory=dict)
    tasks: dict[str, int] = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        """A generic table; its files are listed and their schema is read once a query."""
        if name not in self.seen:
            self.seen[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.seen[name]

    def parts(self, name: str) -> int:
        """Tasks for work on all rows of a generic table, so that each has about ROWS of them at any size; files tell their numbers of rows."""
        if name not in self.tasks:
            self.tasks[name] = max(self.spark.sparkContext.defaultParallelism, self.raw(name).count() // ROWS + 1)
        return self.tasks[name]

    @property
    def account(self) -> DataFrame:
        key = F.col("n_nationkey")
        status = F.when(key >= 20, "DISCONNECTED").when(key >= 15, "ERROR").when(key >= 12, "SYNCING").otherwise("SYNCED")
        return self.raw("nation").select(key.alias("id"), F.col("n_regionkey").alias("user_id"), status.alias("status"), F.col("n_name").alias("label"), (key % 5).alias("failures"))

    @property
    def video(self) -> DataFrame:
        rows = self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.expr("CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 25 AS INT) END").alias("account_id"),
            F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
            "source",
            F.col("n_chars").alias("file_size"),
            F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 600 + doc_id % 5 END").alias("duration"),
            F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT))").alias("created_at"),
        )
        creator = F.expr("CASE WHEN account_id IS NULL OR id % 11 = 0 THEN NULL ELSE 100 * (account_id % 5) + CAST(substring(source, 4) AS INT) END")
        return rows.withColumns({"creator_id": creator, "filename": F.concat("source", F.lit(" - "), "title", F.lit(".mp4")), "node_id": F.concat(F.lit("n"), F.col("id").cast("string"))})

    @property
    def creator(self) -> DataFrame:
        """One row per user and source of private videos; the name is the source."""
        own = self.raw("documents").where("doc_id % 13 <> 0").select(F.expr("CAST(doc_id % 5 AS INT)").alias("user_id"), F.col("source").alias("name")).distinct()
        return own.select((100 * F.col("user_id") + F.substring("name", 4, 9).cast("int")).alias("id"), "user_id", "name")

    def _listed(self, kind: str) -> DataFrame:
        rows = self.raw("events").where(F.col("event_type") == kind)
        rows = rows.select((F.col("user_id") % 5).cast("int").alias("user_id"), F.get_json_object("props", "$.k").cast("long").alias("video_id"), "ts")
        return rows.groupBy("user_id", "video_id").agg(F.max("ts").alias("ts"))

    @property
    def history(self) -> DataFrame:
        return self._listed("view")

    @property
    def watchlist(self) -> DataFrame:
        return self._listed("click")

    @property
    def saved(self) -> DataFrame:
        return self._listed("purchase").withColumn("folder_id", F.expr("CASE WHEN video_id % 4 = 0 THEN NULL ELSE 10 * user_id + CAST(video_id % 4 AS INT) END"))

    @property
    def folder(self) -> DataFrame:
        """Three used folders and one empty one for each user."""
        each = self.raw("region").select(F.col("r_regionkey").alias("user_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
        return each.select((10 * F.col("user_id") + F.col("n")).alias("id"), "user_id", F.concat(F.lit("folder "), F.col("n").cast("string")).alias("name"))

    @property
    def job(self) -> DataFrame:
        status = "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE element_at(array('completed', 'generating', 'unsupported'), CAST(o_orderkey % 3 AS INT) + 1) END"
        rows = self.raw("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 200).alias("video_id"), F.expr(status).alias("status"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("queued_at"),
            (F.col("o_orderkey") % 4).alias("attempts"), (F.col("o_orderkey") % 6).alias("recoveries"),
            F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 7 AS INT))").alias("next_retry_at"),
        )
        lease = F.expr(f"CASE WHEN status = 'generating' AND id % 5 <> 0 THEN least(queued_at + INTERVAL '1' DAY, TIMESTAMP_NTZ '{NOW}' - INTERVAL '1' MINUTE) END")
        error = F.expr("CASE WHEN status = 'failed' THEN element_at(array('max_attempts', 'network', 'unsupported_codec'), CAST(id % 3 AS INT) + 1) END")
        return rows.withColumns({"lease_expires_at": lease, "error_code": error})

    @property
    def remote(self) -> DataFrame:
        """A snapshot of remote files: some of part's rows gone, renamed or resized, and new ones."""
        rows = self.raw("part").where("p_partkey % 17 <> 0").select(
            F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"),
            F.expr("CASE WHEN p_partkey % 13 = 0 THEN concat(p_name, ' (new)') ELSE p_name END").alias("name"),
            F.expr("CAST(p_size AS BIGINT) * 1000 + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END").alias("size"),
            F.expr("1700000000 + p_partkey + CASE WHEN p_partkey % 29 = 0 THEN 60 ELSE 0 END").alias("ts"),
            F.expr("CASE WHEN p_partkey % 31 = 0 THEN 'trash' WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END").alias("parent"),
            F.expr("CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE '1:0*t1' END").alias("fa"),
        )
        new = self.raw("part").where("p_partkey % 23 = 0").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")), "p_name", F.lit(5000).cast("long"), F.col("p_partkey") + 1700000000, F.lit(None).cast("string"), F.lit(None).cast("string"))
        return rows.union(new)

    @property
    def existing(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("name"),
            F.expr("CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END").alias("size"),
            (F.col("p_partkey") + 1700000000).alias("ts"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END").alias("parent"), F.lit("1:0*t1").alias("fa"),
        )

    @property
    def fragment(self) -> DataFrame:
        """Series of fragments per stream: start time, first and one-past-last byte."""
        from pyspark.sql import Window

        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("idx"), "l_quantity").repartition(self.parts("lineitem"), "stream")
        one = lines.groupBy("stream", "idx").agg(F.sum("l_quantity").cast("long").alias("length"))
        before = Window.partitionBy("stream").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("length").over(before), F.lit(0))
        return one.select("stream", "idx", start.alias("start_time"), (start * 100).alias("first_byte"), ((start + F.col("length")) * 100).alias("end_byte"), (F.col("idx") % 2 == 1).alias("keyframe"))


TABLES = {
    "account": "SELECT n_nationkey AS id, n_regionkey AS user_id, CASE WHEN n_nationkey >= 20 THEN 'DISCONNECTED' WHEN n_nationkey >= 15 THEN 'ERROR' WHEN n_nationkey >= 12 THEN 'SYNCING' ELSE 'SYNCED' END AS status, n_name AS label, n_nationkey % 5 AS failures FROM nation",
    "video0": """SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id % 25 AS INTEGER) END AS account_id,
        substr(string_split(text, chr(10))[1], 1, 80) AS title, source, n_chars AS file_size,
        CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 600 + doc_id % 5 END AS duration,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS created_at FROM documents""",
    "video": """SELECT *, CASE WHEN account_id IS NULL OR id % 11 = 0 THEN NULL ELSE 100 * (account_id % 5) + CAST(substr(source, 4) AS INTEGER) END AS creator_id,
        source || ' - ' || title || '.mp4' AS filename, 'n' || id AS node_id FROM video0""",
    "creator": "SELECT DISTINCT 100 * CAST(doc_id % 5 AS INTEGER) + CAST(substr(source, 4) AS INTEGER) AS id, CAST(doc_id % 5 AS INTEGER) AS user_id, source AS name FROM documents WHERE doc_id % 13 <> 0",
    "listed": "SELECT event_type AS kind, CAST(user_id % 5 AS INTEGER) AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS video_id, max(ts) AS ts FROM events GROUP BY ALL",
    "history": "SELECT user_id, video_id, ts FROM listed WHERE kind = 'view'",
    "watchlist": "SELECT user_id, video_id, ts FROM listed WHERE kind = 'click'",
    "saved": "SELECT user_id, video_id, ts, CASE WHEN video_id % 4 = 0 THEN NULL ELSE 10 * user_id + CAST(video_id % 4 AS INTEGER) END AS folder_id FROM listed WHERE kind = 'purchase'",
    "folder": "SELECT 10 * r_regionkey + n AS id, r_regionkey AS user_id, 'folder ' || n AS name FROM region, (SELECT unnest([1, 2, 3, 4]) AS n)",
    "job0": """SELECT o_orderkey AS id, o_orderkey % 200 AS video_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE ['completed', 'generating', 'unsupported'][o_orderkey % 3 + 1] END AS status,
        CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS queued_at, o_orderkey % 4 AS attempts, o_orderkey % 6 AS recoveries,
        o_orderdate + to_days(CAST(o_orderkey % 7 AS INTEGER)) AS next_retry_at FROM orders""",
    "job": f"""SELECT *, CASE WHEN status = 'generating' AND id % 5 <> 0 THEN least(queued_at + INTERVAL 1 DAY, TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE) END AS lease_expires_at,
        CASE WHEN status = 'failed' THEN ['max_attempts', 'network', 'unsupported_codec'][id % 3 + 1] END AS error_code FROM job0""",
    "remote": """SELECT 'p' || p_partkey AS node_id, CASE WHEN p_partkey % 13 = 0 THEN p_name || ' (new)' ELSE p_name END AS name,
        CAST(p_size AS BIGINT) * 1000 + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS size, 1700000000 + p_partkey + CASE WHEN p_partkey % 29 = 0 THEN 60 ELSE 0 END AS ts,
        CASE WHEN p_partkey % 31 = 0 THEN 'trash' WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS parent, CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE '1:0*t1' END AS fa FROM part WHERE p_partkey % 17 <> 0
        UNION ALL SELECT 'q' || p_partkey, p_name, 5000, 1700000000 + p_partkey, NULL, NULL FROM part WHERE p_partkey % 23 = 0""",
    "existing": """SELECT p_partkey AS id, 'p' || p_partkey AS node_id, p_name AS name, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1000 END AS size,
        1700000000 + p_partkey AS ts, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS parent, '1:0*t1' AS fa FROM part""",
    "fragment0": "SELECT l_orderkey AS stream, l_linenumber AS idx, CAST(sum(l_quantity) AS BIGINT) AS length FROM lineitem GROUP BY ALL",
    "fragment1": "SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY stream ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_time FROM fragment0",
    "fragment": "SELECT stream, idx, start_time, start_time * 100 AS first_byte, (start_time + length) * 100 AS end_byte, idx % 2 = 1 AS keyframe FROM fragment1",
}


def sql(query: str) -> str:
    """query with the CTEs of all logical tables before it; ctes of its own follow after a leading WITH."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in TABLES.items())
    rest = query.strip()
    if rest.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    return f"WITH {ctes},\n{rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {ctes}\n{rest}"
