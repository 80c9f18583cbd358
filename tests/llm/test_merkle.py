import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import merkle

from .conftest import frame


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def grow(level):
    """[(node, [(before, after), ...])] of a list of nodes with the way of each to the top, and the top."""
    ways, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 3 : i - i % 3 + 3]
            ways[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return ways, level[0]


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = own, *grow([leaf(r, r.text) for r in own])
    ways, root = grow([trees[s][2] for s in order])
    out = []
    for s, upper in zip(order, ways, strict=True):
        own, lower, subroot = trees[s]
        for r, way in zip(own, lower, strict=True):
            told = r.text
            if told is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                told = told.replace("\n", "")
            node = leaf(r, told)
            for before, after in way + upper:
                node = sha(before + node + after)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha("".join(b + a for b, a in way + upper)), node, node == root))
    return sorted(out, key=repr)


def manifest(docs):
    return sorted(map(tuple, merkle.manifest(docs, merkle.without_newlines()).collect()), key=repr)


def rows(sizes, seed=4):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a\nb", "one line", "", None, "é\n漢"]), rng.choice(["en", None]), source, rng.choice([None, 3])) for source, n in sizes.items() for i in rng.sample(range(1000), n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4}, {None: 1, "": 3, "b": 28, "é": 9, "Z": 10, "=": 1, "c": 2}])
def test_by_brute_force(spark, sizes):
    docs = frame(spark, rows(sizes)).repartition(3)
    assert manifest(docs) == brute(docs.collect())


def test_ranges_and_runs_of_ranges(spark, monkeypatch):
    """A source over many ranges, counts of ranges added up by runs."""
    from shelfwise.llm import sharding

    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    monkeypatch.setattr(sharding, "RUN", 5)
    docs = frame(spark, rows({"hot": 300, "b": 40, None: 20})).repartition(4)
    assert manifest(docs) == brute(docs.collect())


def test_odd_rows(spark, odd):
    assert manifest(odd) == brute(odd.collect())
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_equal_rows_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    docs = frame(spark, [(None, "same", "en", "a")] * 400 + [(1, "x", "en", "a")])
    out = manifest(docs)
    assert [r[1:4] for r in out] == [r[1:4] for r in brute(docs.collect())] and all(r[6] for r in out)
    ranges = merkle.indexed(merkle.written(docs.selectExpr("'' AS group", "doc_id"), "t"), ["doc_id"], "t")
    assert sorted(r.i for r in ranges.collect()) == list(range(401))


def test_any_change_shows(spark):
    docs = frame(spark, rows({"a": 10, "b": 5}))
    assert all(r.verified for r in merkle.manifest(docs).collect())
    changed = merkle.manifest(docs, F.concat(F.col("text"), F.lit("!"))).join(docs.select("doc_id", "text"), "doc_id")
    assert all(r.verified == (r.text is None) for r in changed.collect())


def test_fields_do_not_run_together(spark):
    pairs = [("ab", "c"), ("a", "bc"), (None, "-"), ("-", None), ("", None), (None, "")]
    out = spark.createDataFrame(pairs, "a string, b string").select(merkle.row_digest([F.col("a"), F.col("b")]).alias("h")).distinct().count()
    assert out == len(pairs)
