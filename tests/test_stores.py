import json
import os
from urllib.parse import urlparse

import pytest

from shelfwise.sources.media_store import scanned
from shelfwise.sources.sqlite_store import SqliteReader, local, read_store, write_store
from shelfwise.streaming.feeds import place


@pytest.fixture
def store(spark):
    path = place(spark, "store")
    folder = urlparse(path).path
    os.makedirs(folder)

    def put(name, data):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(data if isinstance(data, bytes) else json.dumps(data).encode())

    return path, put


def test_what_files_are_worth(spark, store):
    path, put = store
    for i in range(1, 12):
        put(f"{i}.mp4", bytes(10 * i))
    put("1.json", {"megaNodeId": "a", "outputSize": 10, "lastAccessedAt": "2026-01-02T03:04:05Z"})
    put("2.json", {"megaNodeId": "a", "outputSize": 21})
    put("3.json", {"megaNodeId": 3, "outputSize": 30})
    put("4.json", {"megaNodeId": "a", "outputSize": "40"})
    put("5.json", b'{"megaNodeId": "a", "outputSize": 50')
    put("6.json", [1])
    put("7.json", {"outputSize": 70})
    put("8.json", {"megaNodeId": "", "outputSize": 80, "lastAccessedAt": "never"})
    put("9.json", b"")
    put("10.json", b"null")
    put("12.mp4", b"")
    put("12.json", {"megaNodeId": "a", "outputSize": 0})
    for name in ("1.ts.part", "2.live.spool", "3.part.mp4", "4.ts.frontier.json", "x.mp4", "1.mp4.bak", "note.txt"):
        put(name, b"12345")
    rows = scanned(spark, path).collect()
    assert {r["id"] for r in rows if r["kind"] == "valid"} == {1, 8} and {r["id"] for r in rows if r["kind"] == "stale"} == {2, 3, 4, 5, 6, 7, 9, 10, 11}
    assert sorted(r["name"] for r in rows if r["kind"] == "temp") == ["1.ts.part", "2.live.spool", "3.part.mp4", "4.ts.frontier.json"] and sum(r["size"] for r in rows if r["kind"] == "temp") == 20
    assert next(r["last_access"] for r in rows if r["name"] == "1.mp4").isoformat() == "2026-01-02T03:04:05"


SCHEMA = "id long, name string, score double, flag long"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i if i % 10 else None, f"n{i % 7}" if i % 4 else None, i / 3, i % 2) for i in range(500)]
    table = spark.createDataFrame(rows, SCHEMA)
    path = place(spark, "sqlite")
    written = write_store(table.repartition(3), path, "People").collect()
    assert sum(r["n"] for r in written) == 500 and len(written) == 3
    return table, path


@pytest.mark.parametrize("where", ["true", "id >= 100 AND id < 120", "name = 'n3'", "name IS NULL", "id IS NULL", "id IN (5, 7, 400)", "score > 100.5 AND flag = 1", "name LIKE 'n%' AND length(name) = 2 AND id > 3"])
def test_a_read_gives_what_was_written(spark, people, where):
    table, path = people
    rows = read_store(spark, path, "People", "id", SCHEMA, range=37).where(where)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, table.where(where).collect()))


def test_partitions_and_filters(spark, people):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, StringStartsWith
    from pyspark.sql.types import _parse_datatype_string

    reader = SqliteReader(_parse_datatype_string(SCHEMA), {"path": people[1], "table": "People", "key": "id", "range": "37"})
    left = list(reader.pushFilters([GreaterThan(("id",), 450), EqualTo(("name",), "n1"), IsNotNull(("id",)), StringStartsWith(("name",), "n")]))
    assert [type(f).__name__ for f in left] == ["StringStartsWith"]
    parts = reader.partitions()
    assert len(parts) >= 3 * 13 and len({(p.file, p.low) for p in parts}) == len(parts)
    found = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == people[0].where("id > 450 AND name = 'n1'").count()


def test_a_mounted_folder_is_needed():
    with pytest.raises(ValueError, match="mounted"):
        local("hdfs://somewhere/store")
