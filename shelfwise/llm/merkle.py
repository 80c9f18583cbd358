"""A Merkle manifest of a table: a digest of each row, trees over them by source, proofs and their check.

Rows of a source, in ascending order, are leaves. Level by level, FANOUT neighbours become one parent, until one
node, the source's subroot, is left; the subroots in the order of their sources give the root in the same way.

A row's index is the number of its source's rows in earlier ranges plus its row_number within its own range, so no
source is numbered in one task. Levels are tables: an index divided by the fanout names the parent, whose children's
digests, sorted by index, are hashed. Proofs come from joins of each level with the one above. What lies above a node is
the same for all leaves below it, so the joins go down from the root: each level puts its own siblings before its
parent's. A leaf takes part in one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.llm.sharding import earlier

FANOUT = 3
#: Rows that one range, and with it one window, is meant to hold.
RANGE_ROWS = 100_000


def field(value: Column) -> Column:
    """A value with its length, so that no two rows have the same text: '-' for null, else the bytes of its text, ':', the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def indexed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (group: a text, never null) with i, the place in the group by order from 0, and n, the group's rows.

    Rows that agree in all of order keep the order in which rows stands in its files: rows must be a written table.
    """
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    by = ["group", *order, "__row"]
    rows = written(rows.repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id()), f"{name}-ranges")
    counts = rows.groupBy("group", "__range").agg(F.count("*").alias("n"))
    base = earlier(counts, ["group"], "__range", "n").drop("n").join(counts.groupBy("group").agg(F.sum("n").alias("n")), "group")
    own = F.row_number().over(Window.partitionBy("group", "__range").orderBy(*order, "__row"))
    return rows.withColumn("__own", own).join(base, ["group", "__range"]).withColumn("i", F.col("__before") + F.col("__own") - 1).drop("__row", "__range", "__own", "__before")


def grown(leaves: DataFrame, name: str, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all groups, from the leaves (group, i, n, digest ...) up; those above have kids, their children's digests in order.

    n is the group's nodes on that level; a group ends on the level where it has one.
    """
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = levels[-1].where("n > 1").groupBy("group", F.expr(f"i div {fanout}").alias("i"))
        nodes = nodes.agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("k"), F.expr(f"(first(n) + {fanout - 1}) div {fanout}").alias("n"))
        nodes = nodes.withColumn("kids", F.col("k.digest")).withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("kids", hex_of), ""), 256)))
        levels.append(written(nodes.select("group", "i", "n", "digest", "kids"), f"{name}-level"))
        most = -(-most // fanout)
    return levels


def proven(levels: list[DataFrame], tops: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """The leaves with path, an array of (before, after): the siblings' digests on both sides, level by level to the root.

    tops: group, path of the group's last node, and what else its leaves shall have.
    """
    above = None
    more = [c for c in tops.columns if c not in ("group", "path")]
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        found = nodes.where("n = 1").join(tops, "group")
        if above is not None:
            up = above.select("group", F.col("i").alias("__up"), F.col("kids").alias("__run"), F.col("path").alias("__path"), *more)
            at = F.expr(f"cast(i % {fanout} as int)")
            side = F.struct(F.array_join(F.transform(F.slice("__run", F.lit(1), at), hex_of), "").alias("before"), F.array_join(F.transform(F.slice("__run", at + 2, F.lit(fanout)), hex_of), "").alias("after"))
            side = F.struct(F.unhex(side["before"]).alias("before"), F.unhex(side["after"]).alias("after"))
            kept = nodes.where("n > 1").withColumn("__up", F.expr(f"i div {fanout}")).join(up, ["group", "__up"])
            found = found.unionByName(kept.withColumn("path", F.concat(F.array(side), "__path")).select(found.columns))
        above = written(found, f"{name}-paths") if k else found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda own, side: F.sha2(F.concat(hex_of(side["before"]), own, hex_of(side["after"])), 256))


def proof(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(hex_of(side["before"]), hex_of(side["after"]))), ""), 256)


def row_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def manifest(docs: DataFrame, told: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of documents.

    told: the text that a holder of the row shows; the column may use all columns of docs. It is folded with the true siblings,
    and verified says whether the true root comes out. Without it the rows' own texts are shown.
    Rows of a source ascend by doc_id (null first), those of one doc_id by their leaf; equal rows are interchangeable. A null
    source is a group of its own and comes first. An empty table has no rows and no root. Other columns are not read.
    """
    rest = ["doc_id", "source", "lang", "n_chars"]
    shown = [F.col(c) for c in rest]
    leaf = F.unhex(row_digest([*shown, F.col("text")]))
    changed = F.lit(None).cast("binary") if told is None else F.when(told != F.col("text"), F.unhex(row_digest([*shown, told])))
    group = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = written(docs.select("doc_id", group.alias("group"), leaf.alias("digest"), changed.alias("changed")), "merkle-rows")
    leaves = written(indexed(rows, ["doc_id", "digest"], "merkle"), "merkle-leaves")
    levels = grown(leaves, "merkle", fanout)
    tops = levels[0].where("n = 1").select("group", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("group", "digest"))
    tops = written(tops.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), "merkle-subroots")
    upper = grown(written(indexed(tops, ["of"], "merkle-top"), "merkle-top-leaves"), "merkle-top", fanout)
    root = next(iter(upper[-1].where("n = 1").select(hex_of(F.col("digest"))).take(1)), [None])[0]
    none = F.array().cast("array<struct<before: binary, after: binary>>")
    start = docs.sparkSession.range(1).select(F.lit("").alias("group"), none.alias("path"))
    subroots = written(proven(upper, start, "merkle-top", fanout).select(F.col("of").alias("group"), F.col("digest").alias("subroot"), "path"), "merkle-subroot-paths")
    found = proven(levels, subroots, "merkle", fanout)
    leaf, back = hex_of(F.col("digest")), folded(hex_of(F.coalesce("changed", "digest")), F.col("path"))
    found = found.select("doc_id", leaf.alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), proof(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The text without its newlines, in the rows where 2 divides crc32 of the doc_id; in the others the text itself."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
