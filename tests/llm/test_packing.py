import zlib

import numpy as np
import pytest

from shelfwise.llm import packing

from .conftest import frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = ["plain words, and more.", "", " two  spaces\n and\tlines \n", "naïve Ünï 漢字 🙂 don't", "<|endoftext|> inside", "x" * 5000, "a b " * 3000, " lead", "trail ", "ſ ǅ word"]


def test_ids_are_the_tokenizers(tokenizer):
    own = packing.encoder(packing.tokenizer_path())
    for text in TEXTS * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_sequences_hold_all_pieces_without_gaps(spark, tokenizer):
    docs = frame(spark, [(i, TEXTS[i % len(TEXTS)] + " w" * (i * 37 % 900)) for i in range(300)]).repartition(8)
    out = packing.pack_documents(docs).toPandas()
    for _, group in out.groupby("doc_id"):
        group = group.sort_values("piece")
        assert (group["start"] == group["length"].cumsum() - group["length"]).all() and (group["length"][1:] == 1024).all()
    order = out.sort_values(["sequence_id", "offset"])
    assert (order["offset"] == order.groupby("sequence_id")["length"].cumsum() - order["length"]).all()
    assert order.groupby("sequence_id")["length"].sum().max() <= 1024
    at_once = packing.best_fit(out["length"].to_numpy(), 1024)[0].max() + 1  # all items in one best-fit pass
    assert out["sequence_id"].nunique() <= 1.02 * at_once + 1
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, packing.pack_documents(docs)).collect()}
    assert sum(map(len, ids.values())) == out["length"].sum()
    one = out[out["doc_id"] == 13].sort_values("piece")
    text = TEXTS[3] + " w" * (13 * 37 % 900)
    own = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert [zlib.crc32(own[a : a + n].tobytes()) for a, n in zip(one["start"], one["length"], strict=True)] == one["ids_crc32"].tolist()


def test_items_that_cannot_share_a_bin(spark):
    items = spark.createDataFrame([(i, 0, 0, 600 if i % 7 else 300, 0) for i in range(2000)], packing.PIECES).repartition(40)
    out = packing.pack(packing.written(items, "items"), 1024).toPandas()
    assert len(out) == 2000 and out["sequence_id"].nunique() <= 1714 + 3
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024


def test_odd_rows(spark, odd):
    out = packing.pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in out) == 12
    assert sorted(r["length"] for r in out if r["doc_id"] in (4, 5)) == [1, 1]
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_bins_left_behind_would_merge_with_none(spark, monkeypatch):
    """Nodes with far more than KEEP underfull bins, all over half full but one, give as few sequences as if all bins went up."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(520, 1000, 5000), rng.integers(100, 480, 12)])
    items = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    items = packing.written(items.repartitionByRange(16, "doc_id"), "items")
    counts = []
    for keep in (256, 10**6):
        monkeypatch.setattr(packing, "KEEP", keep)
        out = packing.pack(items, 1024).toPandas()
        assert len(out) == len(lengths) and out.groupby("sequence_id")["length"].sum().max() <= 1024
        counts.append(out["sequence_id"].nunique())
    assert counts[0] == counts[1]


def test_chunks_of_a_partition_share_their_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 700, 3000)
    items = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES).repartition(40)
    out = packing.pack(packing.written(items, "items"), 1024).toPandas()
    order = out.sort_values(["sequence_id", "offset"])
    assert len(out) == 3000 and (order["offset"] == order.groupby("sequence_id")["length"].cumsum() - order["length"]).all()
    assert out["sequence_id"].nunique() <= packing.best_fit(lengths, 1024)[0].max() + 1 + 12
