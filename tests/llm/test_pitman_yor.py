import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfwise.llm import pitman_yor
from shelfwise.llm.pitman_yor import STRENGTH, Seating, partitions, predictive, seat_contexts, words_of

from .conftest import frame


def test_base_scores_and_better_model(spark, monkeypatch):
    rng = random.Random(5)
    languages = [[f"{a}{i}" for i in range(200)] for a in ("th", "le", "un")]
    rows = [(i, " ".join(rng.choices(own, [1 / (k + 1) for k in range(200)], k=rng.randint(0, 120)))) for i in range(300) for own in [languages[i % 3]]]
    rows += [(900, None), (901, "Unknown WORDS only"), (None, "th1 th2")]
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 3000)
    docs = frame(spark, rows).repartition(4)
    out = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1).collect()}
    assert len(out) == len(rows)
    count = Counter()
    for doc, text in rows:
        if doc is not None and doc % 5 != 1:
            count.update([*words_of(text), None])
    n, v = sum(count.values()), len(count)
    for doc, text in rows:
        own = [*words_of(text), None]
        r = out[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
    held = [r for d, r in out.items() if d is not None and d % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_sweeps_keep_the_exact_law_at_every_count():
    """Numbers of tables of one dish against the weights of all partitions times the rising factor of the restaurant, below and above the tabulated counts."""
    rng = np.random.default_rng(0)
    for n, d, base, others, copies, sweeps in ((2, 0.5, 0.3, 0, 20_000, 1), (24, 0.5, 0.8, 3, 20_000, 1), (128, 0.5, 0.8, 3, 20_000, 1), (129, 0.5, 0.8, 3, 20_000, 8), (160, 0.7, 0.05, 40, 20_000, 8), (400, 0.6, 0.2, 2, 8000, 8), (1200, 0.9, 0.5, 9, 4000, 12), (1200, 0.05, 0.9, 1, 4000, 8), (600, 0.4, 1e-6, 0, 4000, 8), (900, 0.6, 0.02, 2000, 4000, 12)):
        seating = Seating(np.full(copies, n), d)
        total = seating.tables + others  # each copy has a restaurant of its own
        for _ in range(sweeps):
            seating.sweep(np.arange(copies), total, np.full(copies, base), rng)
            assert (total == seating.tables + others).all() and len(seating.opened) == (seating.tables.sum() if n > pitman_yor.SMALL else 0)
        k = np.arange(1, n + 1)
        log = partitions(d, n)[n, 1:] + np.cumsum(np.log((STRENGTH + d * (others + np.arange(n))) * base))
        want = np.exp(log - log.max())
        want /= want.sum()
        got = np.bincount(seating.tables, minlength=n + 1)[1:] / copies
        assert abs((got * k).sum() - (want * k).sum()) < 0.02 * (want * k).sum() + 0.02, (n, d, (got * k).sum(), (want * k).sum())
        assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.015 + 1.2 / np.sqrt(copies), (n, d)


def test_partitions_by_brute_force():
    def ways(n, t, d):
        return float(n == t) if n == 0 or t == 0 else ways(n - 1, t - 1, d) + (n - 1 - d * t) * ways(n - 1, t, d)

    table = partitions(0.3, 9)
    for n in range(10):
        for t in range(n + 1):
            assert math.isclose(math.exp(table[n, t]), ways(n, t, 0.3), rel_tol=1e-12, abs_tol=1e-300)
    x = np.array([1e-3, 0.4, 1.0, 2.5, 7.9, 30.0, 1e6])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_histories_are_proposed_with_their_chance():
    """The chance that is taken into account is the one with which histories come."""
    rng = np.random.default_rng(3)
    seating = Seating(np.full(60_000, 150), 0.5)
    n, others, base = np.full(60_000, 150.0), np.full(60_000, 4.0), np.full(60_000, 0.2)
    owner, place, size = seating._history(n, others, base, rng)
    weight = seating._weight(owner, place, size, n, others, base)
    log = partitions(0.5, 150)[150, 1:] + np.cumsum(np.log((4 + 0.5 * np.arange(150)) * 0.2))
    # the mean of law over chance is the sum of the law's weights, without the factor of the first table
    top = log.max()
    assert math.isclose(np.exp(weight - top).mean(), np.exp(log - top).sum() / 0.8, rel_tol=0.02)


def test_large_counts_take_no_longer():
    rng = np.random.default_rng(2)
    n = np.array([10**3, 10**6, 10**9, 10**12])
    seating = Seating(n, 0.7)
    total = np.array([4])
    for _ in range(30):
        seating.sweep(np.zeros(4, np.int64), total, np.full(4, 0.01), rng)
    assert total[0] == seating.tables.sum() < 200 and (seating.opened <= 10**12).all()


def test_parts_beyond_the_bucket_limit(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "MOST_BUCKETS", 3)
    many = pitman_yor.Parts(spark, 5_000_000)
    assert many.labels is None and many.buckets == 3 and many.number(many.label(4_999_999)) == 4_999_999
    few = pitman_yor.Parts(spark, 3)
    assert few.buckets == 3 == few.n and [few.number(few.label(i)) for i in range(3)] == [0, 1, 2]
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    docs = frame(spark, [(i, " ".join(rng.choices(pool, [1 / (k + 1) for k in range(60)], k=80))) for i in range(120)])
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 1500)
    cut = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1).collect()}
    monkeypatch.setattr(pitman_yor, "MOST_BUCKETS", 50_000)
    whole = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1).collect()}
    for doc, r in whole.items():
        assert r["n_known"] == cut[doc]["n_known"] and math.isclose(r["base_score"], cut[doc]["base_score"], rel_tol=1e-9) and abs(r["score"] - cut[doc]["score"]) < 0.02 * abs(r["score"])


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(1)
    words, contexts = 30, 12
    count = rng.poisson(rng.gamma(0.3, 4, (contexts, words)))
    count[0] = 0
    count[1] = [5000, *[0] * (words - 1)]
    at, word = (x.ravel() for x in np.indices(count.shape))
    base = rng.dirichlet(np.ones(words + 1))  # the last is the unknown word
    last, mean = seat_contexts(at, count.ravel(), base[word], contexts, 0.6, rng)
    assert (last <= count.ravel()).all() and ((last > 0) == (count.ravel() > 0)).all()
    p = predictive(at, count.ravel(), mean, base[word], contexts, 0.6).reshape(count.shape)
    unknown = predictive(np.arange(contexts), np.zeros(contexts, np.int64), np.zeros(contexts), base[-1:].repeat(contexts), contexts, 0.6)
    below = STRENGTH + count.sum(1)
    unknown = (STRENGTH + 0.6 * mean.reshape(count.shape).sum(1)) / below * base[-1]
    assert np.allclose(p.sum(1) + unknown, 1, atol=1e-12)


def test_scores_add_up_to_one_over_all_texts(spark):
    """The model's texts of no word and, by the first word, of one word: all continuations of the start, the unknown word among them."""
    words = ["aa", "ab", "ac", "ad"]
    docs = frame(spark, [(i, " ".join(words[: 1 + i % 4])) for i in range(40)] + [(50 + i, "") for i in range(10)])
    asked = [(100, None)] + [(200 + i, w) for i, w in enumerate([*words, "zz"])] + [(300 + 10 * i + j, f"{w} {x}") for i, w in enumerate([*words, "zz"]) for j, x in enumerate([*words, "zz"])]
    out = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score(docs.unionByName(frame(spark, asked)), F.col("doc_id") < 100).collect()}
    # P(w) P(end | w), and P(w) P(x | w) P(end | x): P(end | x) is the same whatever comes before
    end = {}
    start = {}
    for i, w in enumerate([*words, "zz"]):
        ratio = {x: out[300 + 10 * i + j] / out[200 + j] for j, x in enumerate([*words, "zz"])}  # P(w) P(x | w) / P(x)
        start[w], end[w] = ratio, out[200 + i]
    # unknown words have one probability; solve for the first words' probabilities by iteration
    first = dict.fromkeys(start, 0.2)
    for _ in range(300):
        first = {w: end[w] + sum(start[w][x] * first[x] for x in first) for w in first}
        scale = (1 - out[100]) / sum(first.values())
        first = {w: p * scale for w, p in first.items()}
    total = {w: (end[w] + sum(start[w][x] * first[x] for x in first)) / first[w] for w in first}
    assert all(math.isclose(t, 1, rel_tol=1e-5) for t in total.values()), total


def test_shared_contexts_score_alike(spark, monkeypatch):
    """Frequent contexts dealt to several parts: base scores stay, and so do scores up to the sampler's chance."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w for x in rng.choices(pool, [1 / (k + 1) for k in range(400)], k=40) for w in ("the", x))) for i in range(250)] + [(900, None)]
    docs = frame(spark, rows)
    read = lambda: {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1).collect()}
    monkeypatch.setattr(pitman_yor.Hot, "of", classmethod(lambda cls, texts, parts: cls({}, parts)))
    alone = read()
    shares = {pitman_yor.xxhash.xxh3_64_intdigest(b"the"): 0.5, pitman_yor.xxhash.xxh3_64_intdigest(b"w0"): 0.1, pitman_yor.END: 0.02}
    monkeypatch.setattr(pitman_yor.Hot, "of", classmethod(lambda cls, texts, parts: cls(shares, parts)))
    spread = read()
    for doc, r in alone.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (spread[doc]["n_tokens"], spread[doc]["n_known"], spread[doc]["train_tokens"])
        assert math.isclose(r["base_score"], spread[doc]["base_score"], rel_tol=1e-9)
        assert abs(r["score"] - spread[doc]["score"]) < 0.01 * abs(r["score"]) + 0.01, doc


def test_frequent_contexts_are_found(spark):
    docs = frame(spark, [(i, f"the word{i} THE") for i in range(3000)])
    hot = pitman_yor.Hot.of(docs, 12)
    assert hot.hashes.tolist() == sorted([pitman_yor.xxhash.xxh3_64_intdigest(b"the"), pitman_yor.END]) and hot.parts.max() == 12


def test_a_repeated_text_scores_apart(spark):
    """A text that stands once in training and once outside it is far likelier than one of its own."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(pool, k=60))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000 + i, " ".join(rng.choices(pool, k=60))) for i in range(20)]
    out = {r["doc_id"]: r["score"] for r in pitman_yor.score(frame(spark, rows), F.col("doc_id") < 1000).collect()}
    assert min(out[1000 + i] for i in range(20)) > max(out[2000 + i] for i in range(20)) + 10


def test_odd_rows(spark, odd):
    out = pitman_yor.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(out) == 12 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in out)
    assert pitman_yor.score(frame(spark, []), F.lit(True)).count() == 0
