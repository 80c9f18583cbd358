"""Streams whose slices Spark writes to many files, as it does with larger tables, and state by shards of keys."""

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import streams as P
from shelfwise.sources.catalog import Library
from shelfwise.streaming.feeds import laid_down, run_to_end, stream_of
from shelfwise.streaming.progress import trailing_stream

SMALL = "/root/testdata/sf0.01"


@pytest.fixture
def many_files(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["request_limit", "job_states", "lapsed_leases"])
def test_no_event_of_a_slice_is_late(spark, many_files, name):
    """A watermark that moves within a slice drops the events of its later files."""
    lib = Library(spark, SMALL)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(getattr(P, f"{name}_stream")(lib)) == rows(getattr(P, name)(lib))


def test_many_keys_are_one_row_of_state(spark):
    table = spark.range(3000).select((F.col("id") % 1500).alias("key"), F.col("id").alias("event_id"), F.col("id").alias("t"))
    table = table.unionByName(spark.createDataFrame([(None, 5000, 1), (None, 5001, 2), (2**62 + 1, 5002, 3)], table.schema))
    path = laid_down(table, "key", [F.col("event_id") < 1500, F.col("event_id") >= 1500], "shards")
    out, ended = run_to_end(trailing_stream(stream_of(spark, path, table.schema, 100), 10_000), "shards")
    got = {r["event_id"]: (r["key"], r["done"]) for r in out.collect()}
    assert len(got) == 3003 and got[5001] == (None, 1) and got[5002] == (2**62 + 1, 0) and got[1700] == (200, 1)
    assert ended.lastProgress["stateOperators"][0]["numRowsTotal"] <= 257
