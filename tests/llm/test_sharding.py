import hashlib
import zlib
from collections import Counter

from shelfwise.llm import sharding
from shelfwise.llm.sharding import shard_documents

from .conftest import frame


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, f"text {i}", None, "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3001)]
    out = shard_documents(frame(spark, rows), 16).collect()
    assert len(out) == 3001
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    for source, n in Counter(r["source"] for r in out).items():
        each = Counter(r["shard"] for r in out if r["source"] == source)
        assert all(abs(each[s] - n / 16) <= 2 for s in range(16)), source
    again = shard_documents(frame(spark, rows[::-1]), 16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in out}


def test_odd_rows(spark, odd):
    out = shard_documents(odd, 4).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [3, 3, 3, 3]
    assert {r["size"] for r in out if r["doc_id"] in (4, 5)} == {1} and {r["text_crc32"] for r in out if r["doc_id"] == 4} == {0}
    assert shard_documents(frame(spark, []), 4).count() == 0


def brute(rows, n_shards):
    """{(doc_id, crc): (shard, slot)} by sorting all rows at once."""
    by_source = {}
    for doc, text, _, source in rows:
        crc = zlib.crc32((text or "").encode())
        digest = hashlib.md5(f"17\x1f{doc}\x1f{crc}".encode()).hexdigest()
        by_source.setdefault(source or "", []).append((digest, doc, crc))
    order = []
    for source, own in by_source.items():
        u = (int(hashlib.md5(source.encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        order += [((k - u) / len(own), source, doc, crc) for k, (_, doc, crc) in enumerate(sorted(own), 1)]
    shards = [p * n_shards // len(order) for p in range(len(order))]
    return {(doc, crc): (s, p - shards.index(s)) for p, ((_, _, doc, crc), s) in enumerate(zip(sorted(order), shards, strict=True))}


def test_order_by_brute_force(spark, monkeypatch):
    rows = [(i, f"text {i}", None, "hot" if i % 3 == 0 else f"host{i}" if i % 3 == 1 else f"s{i % 7}") for i in range(1200)] + [(5000, None, None, None)]
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)  # 3 digits: 4096 buckets
    monkeypatch.setattr(sharding, "RUN", 16)
    for n_shards in (16, 7):
        out = shard_documents(frame(spark, rows).repartition(5), n_shards).collect()
        assert {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in out} == brute(rows, n_shards)


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(i, "a", 99, f"s{i}", i, i, i) for i in range(10)], "doc_id long, source string, shard int, __s string, __before int, row int, k int")
    out = sharding.interleave(rows, "source", ["doc_id"], 2).collect()
    assert {(r["doc_id"], r["__s"], r["__before"], r["row"], r["k"]) for r in out} == {(i, f"s{i}", i, i, i) for i in range(10)}
    assert Counter(r["shard"] for r in out) == {0: 5, 1: 5}


def test_equal_rows_are_spread_over_buckets(spark, monkeypatch):
    """Rows of no doc_id, text and source have one digest; no window may hold them all."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = [(None, None, None, None)] * 900 + [(i, f"t{i}", None, "a") for i in range(300)]
    out = shard_documents(frame(spark, rows).repartition(6), 8).collect()
    assert len(out) == 1200 and set(Counter(r["shard"] for r in out).values()) == {150}
    assert all(112 <= sum(r["doc_id"] is None for r in out if r["shard"] == s) <= 114 for s in range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(150))
    seen = []
    real = sharding.earlier
    monkeypatch.setattr(sharding, "earlier", lambda counts, keys, bucket, n: seen.append(counts) or real(counts, keys, bucket, n))
    shard_documents(frame(spark, rows), 8).count()
    assert all(max(r["n"] for r in counts.collect()) <= 60 for counts in seen)
