"""Quality classifier: supervised subword embeddings, averaged over a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm import kernels as K
from kgspark.llm.common import fresh, labelled

#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_PER_CLASS = 1200
N_BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
EPOCHS, RATE, SEED = 6, 2.0, 20240229
#: A document is kept from this probability of good quality on: rejecting needs some certainty.
MIN_PROBABILITY = 0.3
_SHIFT = np.uint64(64 - 17)
_SAME = 0  #: the pair of a word with itself
_START, _END = 2, 3  #: control characters that mark a word's edges


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the row of each.

    Words are what stands between blanks, as it stands. Features are words, pairs of neighbouring words
    (those of a word with itself share a bucket, as there are as many as words), and n-grams of 3 and 4 characters of a word with a mark at its start and its end, by their hashes.
    """
    w = K.split_blanks(texts)
    token, row = w.hashes(), w.rows()
    pairs = K.gram_hashes(token, 2)
    whole = np.flatnonzero(K.whole(w.ptr, 2, len(token)))
    paired = np.where(token[whole] == token[np.minimum(whole + 1, len(token) - 1)], _SAME, (pairs[whole] >> _SHIFT).astype(np.int64)) if len(whole) else whole
    out, rows = [(token >> _SHIFT).astype(np.int64), paired], [row, row[whole]]
    # every word between two marks, one after the other
    size = (w.end - w.start).astype(np.int64)
    head = np.concatenate([[0], np.cumsum(size + 2)])
    data = np.empty(head[-1], np.uint8)
    data[head[:-1]], data[head[1:] - 1] = _START, _END
    data[np.arange(size.sum()) + np.repeat(head[:-1] + 1 - np.cumsum(size) + size, size)] = w.data[np.arange(size.sum()) + np.repeat(w.start - np.cumsum(size) + size, size)]
    char = np.flatnonzero((data & 0xC0) != 0x80)
    after = np.append(char, len(data))
    first = np.searchsorted(char, head)
    length = np.diff(first)
    for n in GRAMS:
        k = np.maximum(length - n + 1, 0)
        at = np.repeat(first[:-1] - np.cumsum(k) + k, k) + np.arange(k.sum())
        out.append((K.span_hashes(data, after[at], after[at + n]) >> _SHIFT).astype(np.int64))
        rows.append(np.repeat(row, k))
    return np.concatenate(out), np.concatenate(rows)


class Model:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (N_BUCKETS, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, 2), np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        """Stochastic gradient descent on the softmax loss; rows are (buckets, shares) with distinct buckets."""
        rng = np.random.default_rng(seed)
        steps, k = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, share = rows[i]
                rate = RATE * (1 - k / steps)
                k += 1
                if not len(ids):
                    continue
                mean = share @ self.vectors[ids]
                score = mean @ self.out + self.bias
                p = np.exp(score - score.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.out @ p
                self.out -= rate * 0.1 * np.outer(mean, p)
                self.bias -= rate * 0.02 * p
                self.vectors[ids] -= (rate * np.minimum(share * len(ids), 4))[:, None] * back
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of class 1: the output layer is linear, so a
        document's score is the mean over its features."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def probability(texts: pa.Array, table: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """P(class 1) of each row, and its number of features."""
    bucket, row = features(texts)
    n = np.bincount(row, minlength=len(texts))
    score = np.bincount(row, table[bucket], len(texts)) / np.maximum(n, 1) + bias
    return 1 / (1 + np.exp(-score)), n


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = TRAIN_PER_CLASS, text: str = "text", key: str = "doc_id") -> Model | None:
    """None if a class has no labelled document."""
    got = labelled(docs, labels, "quality", per_class, text, key).toPandas().sort_values(["_k", "_t"], kind="stable", na_position="first")
    if got["_y"].nunique() < 2:
        return None
    rows = []
    for t in got["_t"]:
        bucket, _ = features(pa.array([t], pa.string()))
        ids, n = np.unique(bucket, return_counts=True)
        rows.append((ids, (n / max(1, len(bucket))).astype(np.float32)))
    return Model().fit(rows, got["_y"].to_numpy(np.int64))


def classify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs without ``text`` but with ``p_quality`` and ``keep``.

    Null, empty and blank texts have no features: probability 0, rejected. Without a model (one class
    only) every other text has probability 1. Texts are read whole; rows are judged alone, so repeated
    rows agree. Empty table: empty result. Names that clash get underscores.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    names = fresh(docs.drop(text), "p_quality", "keep")
    schema = T.StructType([*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())])
    table = model.table() if model else (np.zeros(N_BUCKETS, np.float32), 50.0)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text):
            p, n = probability(pc.fill_null(batch.column(text), ""), *shared.value)
            p = np.where(n > 0, p, 0.0)
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(p), pa.array(p >= MIN_PROBABILITY)], schema.names)

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, p_quality, keep) for every document."""
    return classify(docs.select(F.col(key), F.col(text)), train(docs, labels, text=text, key=key), text=text)
