import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash

from .conftest import frame


def plain(text):
    """Fingerprint by the definition, bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """[(doc_id, fp, component)] by comparing all pairs of fingerprints."""
    by_fp = defaultdict(list)
    for doc, fp in rows:
        by_fp[fp].append(doc)
    root = {f: f for f in by_fp}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = np.array(sorted(by_fp), np.uint64)
    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 2].tolist():
            root[find(g)] = find(int(f))
    least = defaultdict(list)
    for f, docs in by_fp.items():
        least[find(f)] += [d for d in docs if d is not None]
    return sorted(((d, f, min(least[find(f)], default=None)) for d, f in rows), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "Ünï ÀÉ 漢字 x y z a b", "a b c a b c a b c", "A\x0bb\x0cc\rd\te  f"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain(text)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_long_texts_are_hashed_by_blocks():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefg") for _ in range(70_000))
    assert simhash.fingerprint(text) == plain(text)


def nodes(n, seed=5):
    """Random fingerprints, close ones of each, chains of two-bit steps, and a dense ball."""
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(n)]
    found += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in found[: n // 3]]
    step = rng.getrandbits(64)
    for k in range(20):
        found.append(step)
        step ^= 0b11 << (3 * k)
    ball = rng.getrandbits(64)
    found += [ball ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(n)]
    return np.unique(np.array(found, np.uint64))


def test_trees_find_all_and_only_near_nodes_and_prune():
    fps = nodes(900)
    rng = np.random.default_rng(3)
    shard = np.sort(rng.integers(0, 4, len(fps)))
    rng.shuffle(fps)
    trees = simhash.Trees(shard, fps)
    who, node, visited = trees.near(fps, shard)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    a, b = np.nonzero((apart <= 2) & (shard[:, None] == shard[None, :]))
    assert sorted(zip(fps[who].tolist(), trees.nodes[node].tolist(), strict=True)) == sorted(zip(fps[a].tolist(), fps[b].tolist(), strict=True))
    assert visited < 0.5 * sum((shard == s).sum() ** 2 for s in range(4))


def test_edges_hang_by_integer_distance():
    fps = nodes(200)
    trees = simhash.Trees(np.zeros(len(fps), np.int64), fps)
    parent, edge = np.divmod(trees.keys, 65)
    assert (np.bitwise_count(trees.nodes[1:] ^ trees.nodes[parent]) == edge).all() and len(set(trees.keys.tolist())) == len(fps) - 1


def test_every_near_pair_shares_a_shard_at_each_turn():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fixed = 0
        for _ in range(6):
            agreeing = [m for m in simhash.masks(fixed) if a & m == b & m]
            assert agreeing
            fixed = rng.choice(agreeing)
    free = {0}
    for _ in range(6):
        free = {m for f in free for m in simhash.masks(f)}
    assert max(64 - m.bit_count() for m in free) <= 10


@pytest.mark.parametrize(("most", "popular", "trees", "held", "planted"), [(4096, 512, 64, 2_000_000, 400_000), (60, 8, 3, 500, 100), (40, 10, 0, 100, 7)])
def test_components_by_brute_force(spark, monkeypatch, most, popular, trees, held, planted):
    """All trees in tasks; some broadcast and large shards dealt anew, some turns deep; none broadcast."""
    monkeypatch.setattr(simhash, "MOST", most)
    monkeypatch.setattr(simhash, "POPULAR", popular)
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "PLANTED", planted)
    fps = nodes(300)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(5)
    from shelfwise.operators import graph

    found = {r.node: r.root for r in graph.components(simhash.neighbours(frame, trees)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f in fps.view(np.int64).tolist():
        got[found.get(f, f)].add(f & (1 << 64) - 1)
    for d, f, root in brute([(int(f), int(f)) for f in fps]):
        want[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents_by_brute_force(spark):
    from shelfwise.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    out = simhash.components(docs).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out), key=repr) == brute(rows)


def test_odd_rows(spark, odd):
    out = simhash.components(odd.unionByName(frame(spark, [(None, "only here " * 9)]))).collect()
    assert len(out) == 13 and {r.component_id for r in out if r.fp == 0} == {4}
    assert [r.component_id for r in out if r.doc_id == 9] == [9, 9]
    assert {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert sorted((r.component_id for r in out if r.doc_id is None), key=repr) == [1, 4, None]
    assert simhash.components(frame(spark, [])).count() == 0
