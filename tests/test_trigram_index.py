import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import query_language as Q
from shelfwise.sources import trigram_index as I


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefé漢🙂%_\\ ") for _ in range(rng.randrange(1, 8)))
    out = [(i, " ".join(word() for _ in range(rng.randrange(6))), word() + ".mp4", rng.choice(["Ann", "Bé", ""])) for i in range(400)]
    out += [(400, "", "", ""), (401, "rare needle here", "x.mp4", "Ann"), (402, "İstanbul NEEDLE", "y", "Ann")]
    table = spark.createDataFrame(out, "id long, title string, filename string, creator string")
    return table.withColumn("alltext", F.concat_ws("\n", "title", "filename", "creator"))


@pytest.fixture(scope="module")
def index(rows):
    patch = pytest.MonkeyPatch()
    patch.setattr(I, "SHARD_ROWS", 20)
    yield I.TrigramIndex.of(rows)
    patch.undo()


@pytest.mark.parametrize("term", ["a", "ab", "é", "🙂", "abc", "ANN", "needle", "mp4\nann", "%_", "\\", "abcabcabc", "漢", "d e", ".mp", "i̇stan", "zzz", "c" * 9])
def test_terms_as_a_scan_finds_them(rows, index, term):
    node = ("term", term)
    want = {r["id"] for r in rows.where(Q.predicate(node)).collect()}
    assert {r["id"] for r in index.matches(node).collect()} == want


@pytest.mark.parametrize("text", ["abc && !ann", "!(abc || ann)", "ab || cd", "needle && (rare || stanbul)", "mp4 && a && !b"])
def test_queries_as_a_scan_answers_them(rows, index, text):
    node = Q.parse(text)
    assert {r["id"] for r in index.matches(node).collect()} == {r["id"] for r in rows.where(Q.predicate(node)).collect()}


def test_a_rare_term_reads_few_shards(index):
    assert index.shards == 21
    found = index.matches(("term", "needle"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert index.lookup("needle").select("shard").distinct().count() <= 2 < index.shards / 5


def test_the_search_table_changes_in_part(spark):
    from shelfwise.plans.scans import refresh_search_table, search_table, stored_search_table

    video = spark.range(200).selectExpr("id", "concat('t', id) AS title", "'f' AS filename", "cast(id % 40 AS int) AS creator_id")
    creator = spark.range(40).selectExpr("cast(id AS int) AS id", "concat('c', id) AS name")
    table = stored_search_table(search_table(video, creator).select("id", "alltext"), 32)
    before, files = table.manifest(), set(table.read().inputFiles())
    video2 = video.where("id <> 7").withColumn("title", F.when(F.col("id") == 9, "new").otherwise(F.col("title")))
    creator2 = creator.withColumn("name", F.when(F.col("id") == 3, "other").otherwise(F.col("name")))
    refresh_search_table(table, video2, creator2, spark.createDataFrame([(7,), (9,)], "id long"), spark.createDataFrame([(3,)], "id int"))
    got = {tuple(r) for r in table.read().collect()}
    assert got == {tuple(r) for r in search_table(video2, creator2).select("id", "alltext").collect()}
    assert 1 <= sum(before[b] != v for b, v in table.manifest().items()) <= 7 and len(files & set(table.read().inputFiles())) >= 25
