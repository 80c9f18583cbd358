"""Whitening of embeddings by principal components from a randomised range finder.

Vectors become integers once, in a written table; sums and deviations are then exact. A pass applies the covariance to a
basis: each task multiplies its centred rows with the basis and back, and only its dim x basis sums travel. Passes repeat,
each from the orthonormalised product of the one before, on a basis of the wanted components and OVERSAMPLE more, until
Rayleigh-Ritz pairs leave a residual of at most RESIDUAL of the largest eigenvalue, PASSES times at most. If they do
not, the basis is completed to the full dimension and one more pass gives all pairs.

Rows without a vector, or with a null, NaN or infinite entry in it, are dropped. So are vectors of another length than most
have (of two lengths as frequent, the longer counts). Entries beyond 2^56 are set to it. No rows, or no variance, give no
result; a component needs more than RANK of the largest eigenvalue. Rows of one vec_id, or without one, are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, written

COMPONENTS, OVERSAMPLE, PASSES, SEED = 32, 10, 8, 12
RESIDUAL, RANK = 1e-13, 1e-12
SCALE, OFFSET, FAR = 64, 1_000_000, 2.0**56
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, x: floor(64 c) + 1000000 of each entry c, of all rows that count."""
    entry = lambda c: c.cast("double")
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(entry(c) * SCALE, F.lit(-FAR)), F.lit(FAR))) + OFFSET)
    clean = written(rows.where(good).select(F.col("vec_id").cast("long"), x.alias("x")), "whitening")
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return clean.where(F.size("x") == (sizes[0].d if sizes else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums; numbers of over 2^40 are added as Python's."""
    return (x if np.abs(x).max(initial=0) < 1 << 40 and len(x) < 1 << 20 else x.astype(object)).sum(0).tolist()


def totals(clean: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sum of each dimension."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            own = column_sums(matrix(batch["x"])) if batch.num_rows else None
            sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)] if own else sums
            n += batch.num_rows
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(list(map(Decimal, [n, *sums])), pa.decimal128(38, 0))], ["i", "v"])

    found = {i: int(v) for i, v in clean.select("x").mapInArrow(read, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


class Centre:
    """x - S/n without rounding x first: the whole part of the mean goes as integers."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n x - S)^2, exactly; None where a long cannot hold it."""
        y = x - self.whole
        bound = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(1).tolist()
        exact = ((y.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def summed(clean: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(x), a matrix of one shape for each batch of rows; every task sends its own sum, entry by entry."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch["x"]))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])
        give_back()

    found = clean.select("x").mapInArrow(read, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((found.i.max() + 1, found.j.max() + 1))
    out[found.i, found.j] = found.v
    return out


def ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling eigenvalues, their vectors and the residuals' lengths, from a basis and the covariance times it."""
    small = basis.T @ product
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1], inner[:, ::-1]
    vectors = basis @ inner
    return values, vectors, np.linalg.norm(product @ inner - vectors * values, axis=0)


def components(clean: DataFrame, centre: Centre, want: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues, unit eigenvectors (columns), the covariance's trace, and the dimension of the last basis."""

    def applied(basis: np.ndarray) -> tuple[np.ndarray, float]:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre.of(x)
            return np.vstack([y.T @ (y @ basis), np.full((1, basis.shape[1]), (y * y).sum())])

        both = summed(clean, part) / centre.n
        return both[:-1], float(both[-1, 0])

    d = len(centre.whole)
    width = min(d, want + oversample)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    for _ in range(passes):
        product, trace = applied(basis)
        values, vectors, left = ritz(basis, product)
        if width == d or left[:want].max() <= RESIDUAL * values[0]:
            return values[:want], vectors[:, :want], trace, width
        basis = np.linalg.qr(product)[0]
    basis = np.linalg.qr(np.hstack([basis, np.random.default_rng(SEED + 1).standard_normal((d, d - width))]))[0]
    product, trace = applied(basis)
    values, vectors, _ = ritz(basis, product)
    return values[:want], vectors[:, :want], trace, d


def whiten(rows: DataFrame, want: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component."""
    clean = integers(rows)
    n, sums = totals(clean)
    nothing = rows.sparkSession.createDataFrame([], _OUT)
    if not n or not sums:
        return nothing
    centre = Centre(n, sums)
    values, vectors, trace, _ = components(clean, centre, want)
    enough = values > max(RANK * values[0], 0)
    if not enough.any():
        return nothing
    values, vectors = values[enough], vectors[:, enough]
    turn = vectors / np.sqrt(values)
    k = len(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = centre.of(x) @ turn
        return w.T @ w

    error = float(np.abs(summed(clean, products) / n - np.eye(k)).max())
    explained = values / trace

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = matrix(batch["x"])
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(centre.deviation(x), pa.int64()).take(each)]
                    + [pa.array((centre.of(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return clean.mapInArrow(read, _OUT)
