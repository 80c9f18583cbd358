"""Reconciling with a remote snapshot, creators of files, and verified copies of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import attribute_handles, creator_name, mime_of, parsed_name, slug, title_of
from shelfwise.operators.reconcile import plan_changes
from shelfwise.plans import twins
from shelfwise.registry import query
from shelfwise.sources.catalog import Library
from shelfwise.sources.keyed import union_all
from shelfwise.sources.shared import written

PLAN = """SELECT coalesce(r.node_id, e.node_id) AS node_id, r.name, r.size, r.ts, r.parent, r.fa, e.id, e.name AS old_name, r.node_id IS NULL AS gone, e.node_id IS NULL AS fresh,
    list_filter([CASE WHEN e.name IS DISTINCT FROM coalesce(r.name, '') THEN 'rename' END, CASE WHEN coalesce(e.size, -1) <> r.size THEN 'size' END, CASE WHEN e.ts IS DISTINCT FROM r.ts THEN 'timestamp' END,
    CASE WHEN e.parent IS DISTINCT FROM r.parent THEN 'move' END, CASE WHEN e.fa IS DISTINCT FROM r.fa THEN 'file-attributes' END], lambda x: x IS NOT NULL) AS changes FROM remote r FULL JOIN existing e ON e.node_id = r.node_id"""


@query("qry_16_reconcile_plan", f"WITH p AS ({PLAN}) SELECT node_id, CASE WHEN fresh THEN 'add' WHEN gone THEN 'remove' WHEN len(changes) > 0 THEN 'update' ELSE 'unchanged' END AS action, CASE WHEN fresh OR gone OR len(changes) = 0 THEN '' ELSE array_to_string(changes, ',') END AS changes FROM p")
def reconcile_plan(lib: Library) -> DataFrame:
    return plan_changes(lib.remote, lib.existing).select("node_id", "action", F.array_join("changes", ",").alias("changes"))


def as_stored(rows: DataFrame) -> DataFrame:
    """Rows (node_id, name, fa ...) with what is derived from the name: title, creator, mime; and thumbnail from the attributes."""
    parsed = parsed_name(F.col("name"))
    rows = rows.withColumns({"title": F.coalesce(parsed["title"], title_of(F.col("name"))), "creator": F.coalesce(creator_name(parsed["creator"]), F.lit("Unknown Creator")), "mime": mime_of(F.col("name"))})
    return rows.withColumn("thumbnail", F.coalesce(F.try_element_at(attribute_handles(F.coalesce("fa", F.lit(""))), F.lit("0")).isNotNull(), F.lit(False)))


def applied_rows(plan: DataFrame) -> DataFrame:
    """node_id, id, name, title, creator, mime, size, parent, thumbnail: the table after a plan of changes.

    A new row takes all from the remote side; one without a readable name is called after its node. An update takes
    the remote name (the old one where there is none), size and parent, keeps a media type that the new name does
    not tell, and its thumbnail unless the attributes changed. Unchanged rows stay, removed ones go.
    """
    rows = plan.where("action <> 'remove'")
    take = lambda c: F.when(F.col("action") == "unchanged", F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    name = F.when(F.col("action") == "add", F.coalesce("new.name", F.concat(F.lit("video-"), "node_id"))).when(F.col("action") == "update", F.coalesce("new.name", "old.name")).otherwise(F.col("old.name"))
    fa = F.when(F.col("action") == "add", F.col("new.fa")).when(F.array_contains("changes", "file-attributes"), F.col("new.fa")).otherwise(F.col("old.fa"))
    rows = rows.select("node_id", F.col("old.id").alias("id"), name.alias("name"), F.col("old.name").alias("old_name"), take("size").alias("size"), take("parent").alias("parent"), fa.alias("fa"))
    out = as_stored(rows).withColumn("mime", F.coalesce("mime", mime_of(F.col("old_name"))))
    return out.select("node_id", "id", "name", "title", "creator", "mime", "size", "parent", "thumbnail")


NAMED = "CASE WHEN {1} % 43 = 0 THEN NULL WHEN {1} % 2 = 0 THEN 'Watch maker ' || ({1} % 7) || ' - ' || {0} || '.mkv' ELSE {0} || '.webm' END"
PLAN_NAMED = PLAN.replace("remote r", "remote2 r").replace("existing e", "existing2 e")


@query("qry_17_applied_plan", f"""WITH remote2 AS (SELECT node_id, {NAMED.format('name', 'CAST(substr(node_id, 2) AS BIGINT)')} AS name, size, ts, parent, fa FROM remote), existing2 AS (SELECT id, node_id, coalesce({NAMED.format('name', 'id')}, 'old.mp4') AS name, size, ts, parent, fa FROM existing),
    p AS ({PLAN_NAMED}), a AS (SELECT node_id, id, coalesce(name, old_name, 'video-' || node_id) AS name, size, parent, CASE WHEN fresh THEN fa IS NOT NULL WHEN list_contains(changes, 'file-attributes') THEN fa IS NOT NULL ELSE TRUE END AS thumbnail, old_name FROM p WHERE NOT gone),
    b AS (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM a)
    SELECT node_id, id, name, CASE WHEN contains(stem, ' - ') THEN trim(substr(stem, instr(stem, ' - ') + 3)) ELSE trim(stem) END AS title, CASE WHEN contains(stem, ' - ') THEN substr(stem, 7, instr(stem, ' - ') - 7) ELSE 'Unknown Creator' END AS creator,
        CASE WHEN name LIKE '%.mkv' THEN 'video/x-matroska' WHEN name LIKE '%.webm' THEN 'video/webm' WHEN name LIKE '%.mp4' THEN 'video/mp4' END AS mime, size, parent, thumbnail FROM b""")
def applied(lib: Library) -> DataFrame:
    """The table after the plan, of names in two forms and some that cannot be read."""
    number = F.substring("node_id", 2, 20).cast("long")

    def named(n):
        return F.when(n % 43 == 0, None).when(n % 2 == 0, F.concat(F.lit("Watch maker "), (n % 7).cast("string"), F.lit(" - "), "name", F.lit(".mkv"))).otherwise(F.concat("name", F.lit(".webm")))

    remote = lib.remote.withColumn("name", named(number))
    existing = lib.existing.withColumn("name", F.coalesce(named(F.col("id")), F.lit("old.mp4")))
    return applied_rows(plan_changes(remote, existing))


def unique_slugs(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (id, base) with slug: base, or base-2, base-3 ... past those that are taken. Ranks within one base only.

    Of a base that is free the first row gets it plain; numbering goes on after the highest number taken.
    """
    number = F.coalesce(F.nullif(F.regexp_extract("slug", r"-(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(1))
    used = taken.select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), number.alias("n")).groupBy("base").agg(F.max("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    numbered = rows.withColumn("r", order).join(used, "base", "left").withColumn("k", F.coalesce("n", F.lit(0)) + F.col("r"))
    return numbered.select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))


@query("qry_17_unique_slugs", f"""WITH s AS (SELECT id, {twins.slug('title')} AS base FROM video), u AS (SELECT regexp_replace(base, '-\\d+$', '') AS base, max(coalesce(TRY_CAST(nullif(regexp_extract(base, '-(\\d+)$', 1), '') AS INTEGER), 1)) AS n FROM s WHERE id % 2 = 1 GROUP BY ALL),
    k AS (SELECT id, s.base, coalesce(n, 0) + row_number() OVER (PARTITION BY s.base ORDER BY id) AS k FROM s LEFT JOIN u ON u.base = s.base WHERE id % 2 = 0) SELECT id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM k""")
def slugs(lib: Library) -> DataFrame:
    rows = lib.video.where("id % 2 = 0").select("id", slug(F.col("title")).alias("base"))
    return unique_slugs(rows, lib.video.where("id % 2 = 1").select(slug(F.col("title")).alias("slug")).distinct())


WANTED = """SELECT id, account_id % 5 AS user_id, creator_id, CASE WHEN contains(f, ' - ') AND trim(substr(f, instr(f, ' - ') + 3)) <> '' AND instr(f, ' - ') > 1 THEN trim(regexp_replace(substr(f, 1, instr(f, ' - ') - 1), '_+', ' ', 'g')) ELSE '' END AS name
    FROM (SELECT *, regexp_replace(regexp_replace(filename, '^.*[/\\\\]', '', 's'), '\\.[^.]+$', '') AS f FROM video WHERE account_id IS NOT NULL)"""


@query("qry_18_creator_reconcile", f"""WITH w AS ({WANTED}), s AS (SELECT *, {twins.slug("coalesce(nullif(name, ''), 'Unknown Creator')")} AS slug FROM w), k AS (SELECT id AS known_id, user_id, {twins.slug('name')} AS slug FROM creator WHERE id % 3 <> 0)
    SELECT s.user_id, CASE WHEN known_id IS NULL THEN 'create' WHEN known_id IS NOT DISTINCT FROM creator_id THEN 'keep' ELSE 'assign' END AS outcome, count(*) AS videos FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.slug = s.slug GROUP BY ALL""")
def creator_reconcile(lib: Library) -> DataFrame:
    """What reconciling creators with file names would do (a dry run): keep, assign or create, by user. The name comes from the file; manual assignments would stay."""
    rows = lib.video.where("account_id IS NOT NULL").select("id", (F.col("account_id") % 5).alias("user_id"), "creator_id", F.coalesce(parsed_name(F.col("filename"))["creator"], F.lit("")).alias("name"))
    wanted = rows.withColumn("slug", slug(creator_name(F.col("name"))))
    known = lib.creator.where("id % 3 <> 0").select(F.col("id").alias("known_id"), "user_id", slug("name").alias("slug"))
    joined = wanted.join(known, ["user_id", "slug"], "left")
    outcome = F.when(F.col("known_id").isNull(), "create").when(F.col("known_id").eqNullSafe(F.col("creator_id")), "keep").otherwise("assign")
    return joined.groupBy("user_id", outcome.alias("outcome")).agg(F.count("*").alias("videos"))


#: Tables in the order of their dependencies.
COPIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def digest(rows: DataFrame):
    """Count and order-free digest of a table, as one row."""
    return rows.select(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


@query("qry_26_verified_copy", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, TRUE AS ok FROM {t}" for t in COPIED))
def verified_copy(lib: Library) -> DataFrame:
    """All tables copied in the order of their dependencies; each copy is read back, and its count and digest are compared with the source's."""
    checked = []
    for name in COPIED:
        source = lib.raw(name)
        copy = written(source, f"copy-{name}")
        both = digest(copy).unionByName(digest(source))
        same = (F.min("n") == F.max("n")) & (F.min("digest") == F.max("digest"))
        checked.append(both.agg(F.max("n").alias("n"), same.alias("ok")).select(F.lit(name).alias("name"), "n", "ok"))
    return union_all(checked)
