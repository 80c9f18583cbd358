import math

import numpy as np
import pytest

from shelfwise.llm import whitening
from shelfwise.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n string"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 0, 7, "clash") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, want=32):
    """All rows at once: exact deviations, and numpy's eigenvectors of the covariance."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1).tolist()
    y = ((n * x - sums) / n).astype(float)
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1][:want], u[:, ::-1][:, :want]
    return deviation, y @ u / np.sqrt(values), values / (y * y).sum() * n


def check(rows, vectors, ids, want=32):
    deviation, white, explained = brute(vectors, want)
    k = white.shape[1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(ids) * k
    got = np.array([[by[i, c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-7
    assert (np.sign(got * white).sum(0).__abs__() >= len(ids) - 2).all()  # one sign for all rows of a component
    assert [by[i, 1].deviation for i in ids] == deviation and {r.n for r in rows} == {len(vectors)}
    assert max(abs(by[ids[0], c + 1].explained / explained[c] - 1) for c in range(k)) < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_table_by_brute_force(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings")
    kept = [r for r in rows.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(whitening.whiten(rows).collect(), [r.embedding for r in kept], [r.vec_id for r in kept])


def decaying(n=300, d=60, seed=1, rate=0.75):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return ((rng.standard_normal((n, d)) * 3000 * rate ** np.arange(d)) @ q + 5).astype(np.float32).tolist()


def parts(spark, vectors):
    clean = whitening.integers(frame(spark, vectors))
    return clean, whitening.Centre(*whitening.totals(clean))


def test_power_passes_suffice_where_the_spectrum_falls(spark):
    vectors = decaying()
    clean, centre = parts(spark, vectors)
    *_, width = whitening.components(clean, centre, 8)
    assert width == 18  # 8 wanted, 10 more: the full dimension was not needed
    check(whitening.whiten(frame(spark, vectors), 8).collect(), vectors, list(range(len(vectors))), 8)


def test_a_flat_spectrum_takes_the_full_dimension(spark):
    vectors = decaying(rate=0.999)
    clean, centre = parts(spark, vectors)
    *_, width = whitening.components(clean, centre, 8)
    assert width == 60
    check(whitening.whiten(frame(spark, vectors), 8).collect(), vectors, list(range(len(vectors))), 8)


def test_rows_that_do_not_count(spark):
    good = decaying(40, 5, 2)
    bad = [None, [], [None] * 5, [1.0, 2.0, None, 4.0, 5.0], [1.0, float("nan"), 3.0, 4.0, 5.0], [1.0, float("inf"), 3.0, 4.0, 5.0], [1.0, float("-inf"), 3.0, 4.0, 5.0], [1.0, 2.0]]
    rows = frame(spark, good).unionByName(frame(spark, bad, 100)).repartition(7)
    check(whitening.whiten(rows).collect(), good, list(range(40)))


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 9])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).count() == 0


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(8)
    vectors = [[a, b, a, 0.0] for a, b in (rng.integers(-50, 50, (60, 2)) / 2).tolist()]
    out = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9


def test_repeated_rows_and_missing_ids(spark):
    vectors = decaying(30, 4, 3)
    rows = spark.createDataFrame([(None if i % 3 else 1, v) for i, v in enumerate(vectors * 2)], "vec_id long, embedding array<float>")
    out = whitening.whiten(rows).collect()
    assert len(out) == 60 * 4 and {r.n for r in out} == {60}


def test_exact_beyond_longs(spark):
    centre = whitening.Centre(3, [0, 3])
    assert centre.deviation(np.array([[1 << 40, 1]])) == [None] and centre.deviation(np.array([[1 << 30, 1]])) == [9 << 60] if (9 << 60) < 1 << 63 else True
    assert whitening.column_sums(np.full((9, 1), 1 << 62)) == [9 << 62]
    far = [[3e38, 1.0], [-3e38, 2.0], [5.0, 7.0]]
    out = whitening.whiten(frame(spark, far)).collect()
    assert len(out) == 3 and all(math.isfinite(r.whitened) for r in out)  # the second direction is lost beside the first
