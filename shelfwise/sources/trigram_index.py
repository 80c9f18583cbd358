"""An inverted index of trigrams for substring search: which rows can hold a term, without reading their texts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import query_language as Q
from shelfwise.sources.shared import written
from shelfwise.streaming.feeds import place

#: Rows of a shard, whose ids one posting may list; rarest trigrams that a lookup intersects; folders that postings are dealt to.
SHARD_ROWS, PROBES, FOLDERS = 20_000, 4, 16
WIDTH = 3


def grams(text: Column) -> Column:
    """Distinct runs of three characters in lower case; two zero characters at the end make every character begin one."""
    padded = F.concat(F.lower(text), F.lit("\x00" * (WIDTH - 1)))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


class TrigramIndex:
    """Texts by shard, postings (gram, shard, ids) by folder of the gram, and how many rows have each gram; all are tables of files.

    A term's rows are among those that have all its trigrams: the rarest ones are looked up, their ids are intersected within each
    shard, and only texts of shards with candidates are read, where LIKE decides. A term of one or two characters stands at the
    beginning of some trigram, so its rows are those of all trigrams that begin with it.
    """

    def __init__(self, texts: DataFrame, postings: DataFrame, counts: DataFrame, shards: int):
        self.texts, self.postings, self.counts, self.shards = texts, postings, counts, shards

    @classmethod
    def of(cls, rows: DataFrame) -> TrigramIndex:
        """rows: id, alltext and more columns. An id lies in one shard, whatever else its rows have."""
        spark, path = rows.sparkSession, place(rows.sparkSession, "trigrams")
        shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
        texts = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        texts.repartition("shard").write.partitionBy("shard").parquet(f"{path}/texts")
        texts = spark.read.schema(texts.schema).parquet(f"{path}/texts")
        lists = texts.select("id", "shard", F.explode(grams(F.col("alltext"))).alias("gram")).groupBy("gram", "shard").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        lists = lists.withColumn("folder", folder(F.col("gram")))
        lists.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/postings")
        postings = spark.read.schema(lists.schema).parquet(f"{path}/postings")
        counts = written(postings.groupBy("gram", "folder").agg(F.sum(F.size("ids")).alias("n")), "gram-counts")
        return cls(texts, postings, counts, shards)

    def lookup(self, term: str) -> DataFrame:
        """(id, shard) of the rows that may hold a term, in any case."""
        spark = self.texts.sparkSession
        if len(term) < WIDTH:
            low = spark.range(1).select(F.lower(F.lit(term))).first()[0]
            return self.postings.where(F.col("gram").startswith(low)).select(F.explode("ids").alias("id"), "shard").distinct()
        padded = grams(F.lit(term))
        own = spark.range(1).select(F.explode(F.filter(padded, lambda g: ~F.contains(g, F.lit("\x00")))).alias("gram")).withColumn("folder", folder(F.col("gram"))).collect()
        mine = F.col("folder").isin(*{r["folder"] for r in own}) & F.col("gram").isin(*[r["gram"] for r in own])
        known = self.counts.where(mine).orderBy("n", "gram").limit(len(own)).collect()
        if len(known) < len(own):
            return self.postings.where("false").select(F.explode("ids").alias("id"), "shard")
        rarest = known[:PROBES]
        found = self.postings.where(F.col("folder").isin(*{r["folder"] for r in rarest}) & F.col("gram").isin(*[r["gram"] for r in rarest]))
        lists = found.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists")).where(F.size("lists") == len(rarest))
        both = F.aggregate(F.slice("lists", 2, PROBES), F.col("lists")[0]["ids"], lambda a, b: F.array_intersect(a, b["ids"]))
        return lists.select(F.explode(both).alias("id"), "shard")

    def lookup_many(self, terms: DataFrame) -> DataFrame:
        """(term, id) of the rows that may hold each of many terms (term, distinct): those of its rarest trigram. A join on trigrams, which Spark splits where one is hot."""
        low = F.lower(F.col("term"))
        own = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?s)(?=(...))"), F.lit(1)))
        rarest = terms.where(F.length(low) >= WIDTH).select("term", F.explode(own).alias("gram")).join(self.counts.select("gram", "n"), "gram", "left")
        rarest = rarest.groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("term", "r.gram")
        short = terms.where(F.length(low) < WIDTH).select("term", low.alias("low"))
        begun = short.join(self.counts.select("gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("low")), "low").select("term", "gram")
        asked = rarest.unionByName(begun).withColumn("folder", folder(F.col("gram")))
        return asked.join(self.postings, ["folder", "gram"]).select("term", F.explode("ids").alias("id")).distinct()

    def candidates(self, node: tuple) -> DataFrame | None:
        """(id, shard) of the rows that may satisfy a query; None where all may."""
        if node[0] == "term":
            return self.lookup(node[1])
        if node[0] == "not":
            return None
        parts = [self.candidates(child) for child in node[1:]]
        if node[0] == "or":
            return None if None in parts else reduce(DataFrame.unionByName, parts).distinct()
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.join(b, ["id", "shard"], "left_semi"), parts) if parts else None

    def matches(self, node: tuple) -> DataFrame:
        """The rows (with shard) that satisfy a query over alltext, title, filename and creator."""
        found = self.candidates(node)
        if found is None:
            return self.texts.where(Q.predicate(node))
        found = written(found, "candidates")
        shards = [r["shard"] for r in found.select("shard").distinct().collect()]
        return self.texts.where(F.col("shard").isin(*shards)).join(found, ["shard", "id"], "left_semi").where(Q.predicate(node))
