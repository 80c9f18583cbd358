import math
import os
import random
import zlib

import numpy as np
import pytest

from shelfwise.llm import quality

from .conftest import frame


def test_learns_what_labels_mark(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["stone", "river", "quiet", "garden", "letter", "winter"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "CHEAP$$", "click###", "now%%%"]) for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    held = quality.score(docs, model).where(quality.fold(docs["doc_id"]) == 0).collect()
    assert len(held) > 50 and all((r["score"] >= quality.ACCEPT) == (r["doc_id"] % 4 != 0) for r in held)
    again = quality.train(docs.repartition(3), labels)
    assert (again.value == model.value).all() and again.bias == model.bias


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(odd, quality.train(odd, none)).collect()
    assert len(out) == 12 and {r["score"] for r in out} == {0.5}
    model = quality.train(odd, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(odd, model).collect()}
    assert scores[1] == scores[2] and scores[4] == scores[5] == scores[7] and all(0 <= s <= 1 for s in scores.values())
    assert quality.score(frame(spark, []), model).count() == 0


def test_contradicting_labels_and_repeated_rows(spark):
    """One example for each different row of a doc_id; contradicting labels teach nothing."""
    rows = [(1, "good words here")] * 40 + [(1, "other good words"), (2, "bad bad bad"), (4, "good words here"), (6, None), (6, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 0), (4, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    seen = []
    kept, quality._fit = quality._fit, None
    try:
        quality._fit = lambda data: (_ for _ in ()).throw(AssertionError(sorted(zip(data["text"], data["label"], strict=True))))
        with pytest.raises(Exception) as found:
            quality.train(frame(spark, rows), labels)
        seen = str(found.value)
    finally:
        quality._fit = kept
    want = [("bad bad bad", 0), ("good words here", 1), ("other good words", 1)] + ([("", 0)] if zlib.crc32(b"6") % 5 else [])
    want = [w for w in want if {"bad bad bad": 2, "": 6}.get(w[0], 1) and zlib.crc32(str({"bad bad bad": 2, "": 6}.get(w[0], 1)).encode()) % 5]
    assert str(sorted(want)) in seen


def brute(text):
    """Counts of features by their own bytes."""
    words = text.encode().split()
    total = {}
    for word in words:
        padded = b" " + word + b" "
        for key in [("word", word), *((n, padded[i : i + n]) for n in quality.GRAMS for i in range(len(padded) - n + 1))]:
            total[key] = total.get(key, 0) + 1
    for pair in zip(words, words[1:], strict=False):
        for key in [("pair", *pair)] + [("twice",)] * (pair[0] == pair[1]):
            total[key] = total.get(key, 0) + 1
    return total


def test_features_by_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "a", "né", "word", "longer_word", "漢字"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "\n x\t\x0by  ", "x" * 300]
    for text in texts:
        own, weight = quality.example(text)
        want = brute(text)
        n = sum(want.values())
        assert abs(weight.sum() - (n > 0)) < 1e-5 and len(own) >= 0.97 * len(want)
        assert sorted(np.round(weight * n)) == sorted(want.values()) or len(own) < len(want)
    model = quality.Model(np.random.default_rng(2).normal(size=quality.BUCKETS), 0.3)
    alone = [model.logits([t])[0] for t in texts]
    assert np.allclose(alone, [0.3 + float(model.value[o] @ w.astype(np.float64)) for o, w in map(quality.example, texts)], atol=1e-5)
    assert (model.logits(texts) == alone).all()
    monkeypatch.setattr(quality, "PIECE", 64)  # texts in pieces; no word is longer but the last
    assert np.allclose(model.logits(texts)[:-1], alone[:-1], atol=1e-9)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    table, out, bias = rng.normal(size=(50, 16)), rng.normal(size=(16, 2)), rng.normal(size=2)
    own, weight = np.array([1, 7, 30]), np.array([0.5, 0.3, 0.2])
    _, by_mean, by_out, by_bias = quality.loss_and_gradient(table, out, bias, own, weight, 1)
    for array, at, want in ((table, (7, 3), weight[1] * by_mean[3]), (out, (5, 1), by_out[5, 1]), (bias, (0,), by_bias[0])):
        array[at] += 1e-6
        up = quality.loss_and_gradient(table, out, bias, own, weight, 1)[0]
        array[at] -= 2e-6
        assert math.isclose((up - quality.loss_and_gradient(table, out, bias, own, weight, 1)[0]) / 2e-6, want, rel_tol=1e-4, abs_tol=1e-7)
        array[at] += 1e-6


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).where(quality.fold(docs["doc_id"]) == 0).join(labels, "doc_id").collect()
    right = sum((r["score"] >= quality.ACCEPT) == (r["quality"] == 1) for r in scored)
    assert len(scored) >= 50 and right >= 0.97 * len(scored)


def test_first_rows_of_many(spark):
    rows = spark.range(3000).selectExpr("md5(concat('quality', cast(id as string))) AS order", "id AS doc_id", "'d' AS digest", "1 AS label")
    for n in (1, 20, 300, 5000):
        want = rows.orderBy("order", "doc_id").limit(n).collect()
        assert sorted(quality._first(rows, n).collect()) == sorted(want)
