"""Column functions on inputs that only larger tables have."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from shelfwise import registry
from shelfwise.functions import text as T


def test_guessed_creator_takes_no_longer_than_the_name(spark):
    """Names of many words without a mark: nested repeats went through all ways to cut them."""
    words = " ".join(["word"] * 60)
    names = [f"{words}.mp4", f"_{words}.mp4", f"{words} _x__ y.mp4", f"_{words}_-{words}.mp4", f"_{words}__{words}.mp4"]
    begun = time.monotonic()
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(T.guessed_creator(F.col("name")).alias("c")).collect()
    assert [r["c"] for r in rows] == [None, None, None, words, words] and time.monotonic() - begun < 60


def test_guessed_creator_reads_as_before(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab _–-") for _ in range(rng.randrange(1, 13))) for _ in range(4000)]

    def before(name):
        first, second = re.match(r"^_?([^_]+(?:[ _][^_]+)*?)_[–—-]\s*", name), re.match(r"^_([^_]+(?:[ _][^_]+)*?)__", name)
        return first[1].strip(" ") if first else second[1].strip(" ") if second else None

    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.guessed_creator(F.col("name")).alias("c")).collect()
    want = {n: before(n) for n in names}
    assert {r["name"]: r["c"] for r in rows} == want and sum(c is not None for c in want.values()) > 500


def test_timeline_windows_round_as_decimals(spark, tmp_path):
    """Sizes and durations where a product in binary lies one step below the decimal one: a start fell into the block before."""
    cases = [(7896, 5), (9212, 10), (10528, 6), (11656, 11), (10716, 12), (10904, 17), (8836, 8), (11280, 13), (9400, 9), (11844, 19)]
    rows = [(i, "t", "src1", n) for n, i in cases] + [(1000 + i, "t", "src1", 188 * k) for k in range(1, 400) for i in [k]]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    for name in ("mat_15_timeline_window",):
        text = registry.oracle_sql()[name]
        for table in "region nation customer supplier part orders lineitem events".split():
            engine.execute(f"CREATE VIEW IF NOT EXISTS {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
        want = sorted(engine.execute(text).fetchall())
        got = sorted(tuple(r) for r in registry.queries()[name](spark, path).collect())
        assert got == want and len(got) > 300
