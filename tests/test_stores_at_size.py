"""Stores of many files: folders, tasks and what the driver holds grow no faster than the rows."""

import os
from urllib.parse import urlparse

import duckdb
import pytest

from shelfwise import registry
from shelfwise.plans import scans
from shelfwise.sources import media_store, sqlite_store
from shelfwise.sources.catalog import Library
from shelfwise.streaming.feeds import place


def test_store_files_share_folders_and_are_listed_by_tasks(spark, monkeypatch):
    """Each file had a folder of its own, made and moved one after another, and all files were listed on the driver, twice."""
    paths = []
    monkeypatch.setattr(scans, "place", lambda *a: paths.append(place(*a)) or paths[-1])
    rows = scans.scanned_store(Library(spark, "/root/testdata/sf0.01"))
    top = urlparse(paths[0]).path
    folders = [f for f, own, _ in os.walk(top) if f != top]
    files = [name for _, _, own in os.walk(top) for name in own if not name.endswith(".crc")]
    assert len(folders) == 1 and len(files) == len(set(files)) == 186
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "FileScan text" not in plan
    assert sum(r["entries"] for r in rows.collect()) == 94


@pytest.fixture
def many(spark, monkeypatch):
    monkeypatch.setattr(media_store, "FOLDER", 100)
    path = place(spark, "store with a space")
    rows = spark.range(1, 1501).selectExpr("concat(id, IF(id > 1000, '.json', '.mp4')) AS name", "'x' AS value")
    rows = rows.unionByName(rows.where("name = '7.mp4'").selectExpr("name", "'y' AS value")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS name, 'x' AS value"))
    return media_store.write_files(rows, path, 1500, 5), path


def test_files_are_dealt_to_folders(spark, many):
    """A run that is repeated puts the same files in place; rows of one name are lines of one file; hidden files are none."""
    written, path = many
    for _ in range(2):
        assert sum(r["n"] for r in written.collect()) == 1500
    top = urlparse(path).path
    assert len(os.listdir(top)) == 16 and not [n for _, _, own in os.walk(top) for n in own if n.startswith(".")]
    for name in (".1.mp4", "_2.mp4", "3000.mp4", "0/.3.mp4", "0/sub/.deep/4.mp4", "0/sub/5000.mp4", ".gone/6.mp4"):
        os.makedirs(os.path.dirname(f"{top}/{name}"), exist_ok=True)
        with open(f"{top}/{name}", "w") as file:
            file.write("12345")
    files = media_store.listing(spark, path, 5)
    assert files.rdd.getNumPartitions() == 5
    sizes = {r["name"]: r["size"] for r in files.collect()}
    assert len(sizes) == files.count() == 1502 and sizes["7.mp4"] == 4 and sizes["8.mp4"] == 2 and sizes["3000.mp4"] == sizes["5000.mp4"] == 5
    assert {(r["name"], r["value"]) for r in media_store.contents(files.where("name IN ('7.mp4', '1400.json')"), path).collect()} == {("7.mp4", "x\ny\n"), ("1400.json", "x\n")}


def test_a_store_without_files(spark):
    path = place(spark, "store")
    assert media_store.write_files(spark.createDataFrame([], "name string, value string"), path, 0, 3).count() == 0
    assert media_store.scanned(spark, path).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        media_store.scanned(spark, f"{path}/nowhere")


def test_bytes_are_handed_over_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media_store, "BYTES", 10)
    for i in range(20):
        (tmp_path / f"{i}.json").write_bytes(b"\xc3\xa4\r\n" * i)
    rows = media_store.contents(media_store.listing(spark, str(tmp_path)), str(tmp_path), 2).collect()
    assert {(r["name"], r["value"]) for r in rows} == {(f"{i}.json", "ä\r\n" * i) for i in range(20)}


@pytest.mark.parametrize("apart", [1, 1_001])
def test_tasks_of_a_foreign_store_grow_with_its_rows(spark, tmp_path, apart):
    """Four files had all keys each, read by 300 keys: 268 tasks for 20,000 rows, and more where keys lie apart."""
    rows, name = 20_000 if apart == 1 else 2_000, "src_07_foreign_store"
    spark.range(rows).selectExpr(f"id * {apart} AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 20
    engine = duckdb.connect()
    for table in "region nation supplier part orders lineitem events documents".split():
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    engine.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = engine.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > rows / 2


def test_ranges_of_keys_far_apart(spark):
    path = place(spark, "sqlite")
    table = spark.range(100).selectExpr("IF(id = 7, NULL, id * id * 1000000000) AS id", "concat('n', id) AS name")
    assert sqlite_store.write_store(table.repartitionByRange(2, "id"), path, "T").selectExpr("sum(n)").first()[0] == 100
    rows = sqlite_store.read_store(spark, path, "T", "id", "id long, name string", range=10)
    assert rows.rdd.getNumPartitions() <= 2 * (4 * 50 // 10 + 3)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, table.collect()))
