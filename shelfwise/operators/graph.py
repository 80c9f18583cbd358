"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each is linked to. edges: a, b.

    By turns of large and small stars: each node hands its larger neighbours to the least node around it, then its
    smaller ones, until nothing changes. Every round is a written table. The minima are taken in part before they
    are shuffled; the join with a hub's row is one that Spark splits by itself.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: centre, b: neighbour
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        ends = F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = written(large.join(least, "b").select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            root = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
            return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
        before = now
