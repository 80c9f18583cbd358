"""Quality classifier on supervised subword embeddings.

Every word, pair of neighbouring words, word said twice in a row (as such, whatever the word is) and character
n-gram of a word (with the spaces around it) is hashed to a row of an embedding table; a document is the mean of the rows of all its features, followed by a linear
layer and a softmax. Table and layer are learned together by stochastic gradient descent on the log loss in
numpy, on a bounded sample of labelled documents. As the mean
is linear, a trained model is one number for each row, which is what goes to the workers: a table whose size
does not depend on the data.

Words are what stands between ASCII white space. Texts of any length are read whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import give_back, written
from shelfwise.llm.shingles import mix

#: Rows of the embedding table (a power of two), its width, character n-grams in bytes.
BITS, WIDTH, GRAMS = 18, 16, (3, 4)
BUCKETS = 1 << BITS
#: The bound of the labelled sample that a model is fitted on.
SAMPLE = 2_000
#: Passes, step size of the layer, and how many times larger the steps of the table are, whose rows have small shares in a mean.
EPOCHS, RATE, ROWS, SEED = 6, 0.5, 20, 5
#: Bytes that are read at a time; only a word longer than that is read as several.
PIECE = 1 << 20
#: A score from which a document counts as label 1.
ACCEPT = 0.3

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE = 0x9E3779B97F4A7C15
_TIMES, _BACK = (np.cumprod(np.array([1, *[b] * (PIECE + 2)], np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(64 - BITS)).astype(np.int64)


def pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, int, bool]]:
    """All texts in runs of up to PIECE bytes: (bytes, start of each text in them, number of the first text, whether its beginning came before)."""
    held, starts, size, first, goes_on = [], [], 0, 0, False
    for number, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass") + b" "
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE:
                end = max(data.rfind(b" ", at, at + PIECE), data.rfind(b"\n", at, at + PIECE)) + 1 or at + PIECE
            if size and size + end - at > PIECE:
                yield b"".join(held), np.array(starts), first, goes_on
                held, starts, size = [], [], 0
            if not size:
                first, goes_on = number, at > 0
            starts.append(size)
            held.append(data[at:end])
            size, at = size + end - at, end
            if at < len(data):
                yield b"".join(held), np.array(starts), first, goes_on
                held, starts, size = [], [], 0
    if size:
        yield b"".join(held), np.array(starts), first, goes_on


def features(data: bytes, starts: np.ndarray, before: np.uint64 | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.uint64 | None]:
    """(places, buckets) of all features by kind, places rising, and the hash of the last word. before: of the word before data in the same text."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    space = _SPACE[a]
    a = np.where(space, np.uint8(32), a).astype(np.uint64)
    found = []
    for n in GRAMS:
        inside = ~space[1 : len(a) - n + 2]
        for i in range(2, n - 1):
            inside = inside & ~space[i : len(a) - n + 1 + i]
        at = np.flatnonzero(inside)
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            gram = (gram << np.uint64(8)) | a[at + i]
        found.append((at, _bucket(gram)))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(a * _TIMES[: len(a)], dtype=np.uint64)])
    word = mix((total[end] - total[begin]) * _BACK[begin])
    found.append((begin - 1, _bucket(word)))
    if len(word):
        own = np.searchsorted(starts, begin - 1, side="right")
        left = np.concatenate([[np.uint64(0) if before is None else before], word[:-1]])
        pair = np.concatenate([[before is not None and own[0] == 1], own[1:] == own[:-1]])
        found.append(((begin - 1)[pair], _bucket(left[pair] * _PAIR + word[pair])))
        twice = pair & (left == word)
        found.append(((begin - 1)[twice], _bucket(np.full(twice.sum(), 2, np.uint64))))
    last = word[-1] if len(word) and own[-1] == len(starts) else before if len(starts) == 1 else None
    return found, last


@dataclass(frozen=True)
class Model:
    """value: each bucket's share of the logit of label 1; bias: the rest of it."""

    value: np.ndarray
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        sums, counts, last = np.zeros(len(texts)), np.zeros(len(texts)), None
        for data, starts, first, goes_on in pieces(texts):
            found, last = features(data, starts, last if goes_on else None)
            for at, bucket in found:
                ends = np.append(np.searchsorted(at, starts), len(at))
                some = np.flatnonzero(ends[1:] > ends[:-1])
                if len(some):
                    sums[first + some] += np.add.reduceat(self.value[bucket], ends[some])
                    counts[first + some] += (ends[1:] - ends[:-1])[some]
        return np.round(self.bias + sums / np.maximum(1, counts), 9)


def example(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of its features in each."""
    total, last = np.zeros(BUCKETS, np.int64), None
    for data, starts, _, goes_on in pieces([text]):
        found, last = features(data, starts, last if goes_on else None)
        for _, bucket in found:
            total += np.bincount(bucket, minlength=BUCKETS)
    own = np.flatnonzero(total)
    return own, (total[own] / max(1, total.sum())).astype(np.float32)


def loss_and_gradient(table: np.ndarray, out: np.ndarray, bias: np.ndarray, own: np.ndarray, weight: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log loss of one text, and its gradient by the text's mean vector, the layer and the bias; a row's own is weight times the first."""
    mean = weight @ table[own]
    z = mean @ out + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    loss = -float(np.log(p[label]))
    p[label] -= 1
    return loss, out @ p, np.outer(mean, p), p


def _fit(rows: pd.DataFrame) -> Model:
    rng = np.random.default_rng(SEED)
    table = (rng.random((BUCKETS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
    out, bias = (rng.random((WIDTH, 2), dtype=np.float32) - 0.5) / WIDTH, np.zeros(2, np.float32)
    examples = [(*example(text), int(label)) for text, label in zip(rows["text"], rows["label"], strict=True)]
    steps, step = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            own, weight, label = examples[i]
            _, by_mean, by_out, by_bias = loss_and_gradient(table, out, bias, own, weight, label)
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            table[own] -= (rate * ROWS * weight)[:, None] * by_mean
            out -= rate * by_out
            bias -= rate * by_bias
    return Model((table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fold(doc_id) -> object:
    """crc32 of the doc_id written as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows by order, doc_id and digest. Digests are spread evenly, so those below a bound that about 4 n are expected to pass hold them; no task sees many more."""
    total = rows.count()
    if total > 8 * n:
        few = rows.where(F.col("order") < f"{int(4 * n / total * 2**64):016x}")
        rows = few if few.count() >= n else rows
    return rows.orderBy("order", "doc_id", "digest").limit(n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents outside fold 0, the first in the order of a digest of their ids.

    One task reads that sample. Null labels, labels without a document and contradicting labels of one doc_id are
    left out; rows of one doc_id with other texts are examples of their own, repeated rows are one. Without any
    labelled document the model gives every text 0.5. Only text is an input.
    """
    marks = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
    marks = marks.where("label = other").select("doc_id", "label")
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("digest"))
    order = F.md5(F.concat(F.lit("quality"), F.col("doc_id").cast("string")))
    picked = named.select("doc_id", "digest").join(marks, "doc_id").select(order.alias("order"), "doc_id", "digest", "label").distinct()
    picked = _first(written(picked, "labelled"), sample)
    chosen = named.join(F.broadcast(picked), ["doc_id", "digest"]).groupBy("order", "digest", "label").agg(F.min("text").alias("text"))  # at most sample rows of ids and digests

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            model = _fit(pd.concat(rows).sort_values(["order", "digest"]))
            yield pd.DataFrame({"value": [model.value.astype("<f4").tobytes()], "bias": [model.bias]})
        rows.clear()
        give_back()

    found = chosen.repartition(1).mapInPandas(fit, "value binary, bias double").collect()
    if not found:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.frombuffer(found[0]["value"], "<f4").astype(np.float64), found[0]["bias"])


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with the column to (probability of label 1, 0 to 1); a null text is an empty one, whose score is the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.value.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value, bias = shared.value
        model = Model(value.astype(np.float64), bias)
        for batch in batches:
            yield pd.Series(1 / (1 + np.exp(-model.logits(batch.tolist()))), dtype=float)
        give_back()

    return docs.withColumn(to, probability(F.coalesce(F.col("text"), F.lit(""))))
