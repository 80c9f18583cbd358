import os
import random
from itertools import combinations

import numpy as np
import pytest

from shelfwise.llm import jaccard_join
from shelfwise.llm.shingles import WordHashes, shingles

from .conftest import frame


def brute(rows, threshold=0.8):
    hashes = WordHashes()
    sets = {d: set(shingles(hashes.of(t)).tolist()) for d, t in rows if d is not None}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    root = {d: d for d in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {d: (root[d], sum(d in x for x in links)) for d in sets}


def variants(rng, n, base_words, edits):
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    base = [word() for _ in range(base_words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(base_words)] = word()
        out.append(" ".join(own))
    return out


def test_finds_every_link(spark, monkeypatch):
    rng = random.Random(7)
    texts = variants(rng, 60, 200, 8) + variants(rng, 40, 30, 2) + variants(rng, 30, 150, 20) + [v for _ in range(80) for v in variants(rng, 2, rng.randint(1, 300), 3)]
    rows = list(enumerate(texts)) + [(5000 + i, texts[i]) for i in range(5)]
    want = brute(rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # groups of several blocks
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, rows)).collect()}
    assert out == want


def test_splits_large_buckets(spark, monkeypatch):
    rng = random.Random(8)
    rows = list(enumerate(variants(rng, 90, 200, 6) + [v for _ in range(20) for v in variants(rng, 2, 200, 3)]))
    monkeypatch.setattr(jaccard_join, "LARGE", 10)
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, rows)).collect()}
    assert out == brute(rows)


def found_in_one_bucket(spark, sets, leaf):
    """Links between sets (size, 256 bytes) that all share one bucket and nothing else."""
    rows = [(i, size, bytes(low), [leaf]) for i, (size, low) in enumerate(sets)]
    edges = jaccard_join._buckets(spark.createDataFrame(rows, "rep long, size int, bytes binary, leaves array<long>"), 0.8)
    return {(min(r), max(r)) for r in edges.collect()}


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(jaccard_join, "LARGE", 8)
    apart = [rng.randbytes(256) for _ in range(200)]  # splits well
    alike = [low[:60] + bytes(68) + low[128:] for low in (rng.randbytes(256) for _ in range(100))]  # does not split, and no two are near
    for lows in (apart, alike):
        sets = [(100, low) for low in lows for _ in range(2)]
        assert found_in_one_bucket(spark, sets, 4242) == {(i, i + 1) for i in range(0, len(sets), 2)}


def test_large_buckets_are_split_by_their_own_kind(spark, monkeypatch):
    """Sets of 155 and 165 shingles are alike in their binned values only, and so is their bucket (an odd one)."""
    rng = random.Random(10)
    monkeypatch.setattr(jaccard_join, "LARGE", 8)
    binned = [rng.randbytes(128) for _ in range(200)]
    sets = [(size, low) for b in binned for size, low in ((155, rng.randbytes(128) + b), (165, bytes(128) + b))]
    assert found_in_one_bucket(spark, sets, 4243) == {(i, i + 1) for i in range(0, len(sets), 2)}
    assert all((node & 1 == kind).all() for kind in (0, 1) for node in jaccard_join.leaves(np.arange(256, dtype=np.uint64).reshape(2, 128), kind))


def test_odd_rows(spark, odd):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[2]["n_links"] >= 1
    assert all(by[d]["class_id"] == d and by[d]["n_links"] == 0 for d in (4, 5, 6, 7, 8, 9))
    assert {r["class_id"] for r in rows if r["doc_id"] is None} == {1, None}
    assert jaccard_join.join(frame(spark, [])).count() == 0


def test_one_run_finds_what_it_should():
    """Sets at the threshold, by simulation: the chance that a run puts both in one bucket."""
    rng = np.random.default_rng(3)
    met = total = 0
    rates = []
    for binned, n in ((False, 90), (True, 900)):
        for _ in range(60):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            pair = [np.unique(np.concatenate([both[: n * 8 // 10], part])) for part in (both[n * 8 // 10 : n * 9 // 10], both[n * 9 // 10 :])]
            a, b = (set(x.tolist()) for x in jaccard_join.leaves(np.array([jaccard_join.signature(s, binned) for s in pair]), int(binned)))
            met, total = met + bool(a & b), total + 1
            per_run = [jaccard_join.descend(np.array([jaccard_join.signature(s, binned) for s in pair]), np.arange(2), np.full(2, 1000 + r, np.uint64)) for r in range(40)]
            assert all(len(nodes) >= 2 for _, nodes in per_run)
            found = sum(bool(set(nodes[rows == 0].tolist()) & set(nodes[rows == 1].tolist())) for rows, nodes in per_run)
            rates.append(found / 40)
    assert met == total and np.mean(rates) >= jaccard_join.ONE_RUN - 0.02 and jaccard_join.RUNS == 16


def test_recall_on_the_test_table(spark):
    """Every id divisible by 100 against all rows, by brute force."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows, hashes = [tuple(r) for r in docs.collect()], WordHashes()
    sets = {d: set(shingles(hashes.of(t)).tolist()) for d, t in rows}
    links = {d: sum(o != d and sets[o] and len(sets[d] & sets[o]) >= 0.8 * len(sets[d] | sets[o]) - 1e-9 for o in sets) for d in sets if d % 100 == 0 and sets[d]}
    found = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(docs).where("doc_id % 100 = 0").collect()}
    assert {d: found[d] for d in links} == links


def test_keep_one_tells_rows_apart(spark):
    a, b = "the quick brown fox jumps over a lazy dog by the river", "an entirely other text that nobody has seen before today"
    rows = [(1, a), (9, a), (9, b), (9, b), (None, a), (None, "one more text of its own that has no id at all"), (None, None), (None, None), (3, ""), (3, "")]
    left = jaccard_join.keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, a), (9, b), (0, rows[5][1]), (0, ""), (0, ""), (3, ""), (3, "")])
