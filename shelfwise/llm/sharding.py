"""Sharding by proportional stratified interleaving.

Rows are put in a seeded order within their source, each gets the fraction of its source that lies
before it, and the order of those fractions over all sources is cut into equal runs. Every run then
holds each source in proportion, and row counts of shards differ by one at most.

Row k of a source of m rows has the fraction (k - u) / m. The shift u of a source, between 0 and 1, comes
from its digest, so that sources of a few rows do not all ask for the same places.

No source, however large, is ranked in one task: a row's rank is the number of rows of its source in
earlier hash buckets (a small table of counts) plus its place in its own bucket. The place in the
whole order is found in the same way over buckets of fractions. Rows are written once, with their digests; a row that
stands more often than a bucket may hold gets digests of its own for each share of its copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written

#: Rows that one window is meant to hold; more rows mean more buckets. Buckets whose counts one window adds up.
BUCKET_ROWS, RUN = 20_000, 4096


def earlier(counts: DataFrame, keys: list[str], bucket: str, n: str) -> DataFrame:
    """counts with __before: the sum of n over the lower buckets of the same keys, by runs of buckets, so that no window holds all of them."""
    counts = counts.withColumn("__run", F.expr(f"{bucket} div {RUN}"))
    runs = counts.groupBy(*keys, "__run").agg(F.sum(n).alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "__run", F.coalesce(below, F.lit(0)).alias("__base"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "__run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(runs, [*keys, "__run"]).withColumn("__before", F.col("__base") + F.coalesce(inside, F.lit(0))).drop("__run", "__base")


def shift(source: Column) -> Column:
    """Between 0 and 1, never either."""
    return (F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2**32


def interleave(rows: DataFrame, stratum: str, order: list[str], n_shards: int = 16, seed: int = 17) -> DataFrame:
    """rows with the columns shard and slot (place in the shard, from 0), which replace columns of those names.

    order: columns whose values set the seeded order; rows that agree in all of them and in stratum
    are interchangeable copies and get neighbouring places, up to BUCKET_ROWS of them together. A null stratum counts as the stratum ''.
    An empty table gives an empty result. All other columns stay, whatever their names are.
    """
    rest = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in order]))
    rows = rows.select(F.struct(*rest).alias("row"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("source"), digest.alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows, "shard-rows")
    n = rows.count()
    often = rows.groupBy("source", "digest").agg(F.count("*").alias("copies")).where(F.col("copies") > BUCKET_ROWS)  # fewer than n / BUCKET_ROWS
    if often.limit(1).count():
        share = F.pmod(F.xxhash64("at"), F.ceil(F.col("copies") / (BUCKET_ROWS / 2)))
        rows = rows.join(often, ["source", "digest"], "left").withColumn("digest", F.when(F.col("copies").isNull(), F.col("digest")).otherwise(F.md5(F.concat_ws("\x1f", "digest", share)))).drop("copies")
    digits = max(2, math.ceil(math.log(max(n / BUCKET_ROWS, 1), 16)))
    rows = rows.withColumn("b", F.conv(F.substring("digest", 1, digits), 16, 10).cast("long"))
    counts = rows.groupBy("source", "b").agg(F.count("*").alias("n"))
    before = earlier(counts, ["source"], "b", "n").drop("n").withColumnRenamed("__before", "before").join(counts.groupBy("source").agg(F.sum("n").alias("of")), "source")
    own = Window.partitionBy("source", "b").orderBy("digest", "at")
    ranked = rows.join(before, ["source", "b"]).withColumn("k", F.col("before") + F.row_number().over(own))
    ranked = ranked.withColumn("f", (F.col("k") - shift(F.col("source"))) / F.col("of")).withColumn("j", F.floor(F.col("f") * max(64, 16**digits)).cast("long"))
    starts = earlier(ranked.groupBy("j").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "j", "n").select("j", F.col("__before").alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("j").orderBy("f", "source")) - 1
    placed = ranked.join(starts, "j").select("row", place.alias("p")).withColumn("shard", F.expr(f"cast((p * {n_shards}) div {max(1, n)} as int)"))
    return placed.select("row.*", "shard", F.expr(f"p - (shard * {n}L + {n_shards - 1}) div {n_shards}").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot. A null text is empty; a text of any length is one row of a few numbers."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(narrow, "source", ["doc_id", "text_crc32"], n_shards, seed)
