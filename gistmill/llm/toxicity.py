"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased; a document's features are its distinct words, pairs of neighbours and
pairs with one word between, hashed into a fixed number of coordinates. Learning runs over a bounded sample of labelled
rows in one task, one document after another in the order of their hashed ids; each coordinate has its own rate, and L1
leaves few weights. The non-zero weights, at most one a coordinate, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import blocks, pick, ship, text_bytes
from .quality import labelled_sample

#: Coordinates (a power of two), and the labelled rows that are learned from at most.
COORDINATES, SAMPLE_ROWS = 1 << 20, 12_000

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


_SHIFT = np.uint64(64 - (COORDINATES - 1).bit_length())


def occurrences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate of each occurrence of a feature, and its text's index."""
    words = common.Words(raw, offsets, lower=True, apart=_APART)
    found, of = [words.hash >> _SHIFT], [words.text_of]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        if len(words.hash) > gap:
            same = words.text_of[:-gap] == words.text_of[gap:]
            pairs = words.hash[:-gap] * np.uint64(salt) + words.hash[gap:]
            found.append(((pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB) >> _SHIFT)[same])
            of.append(words.text_of[:-gap][same])
    return np.concatenate(found).astype(np.int32), np.concatenate(of)


def distinct(at: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of each text, one after another, and the bounds of each text's."""
    key = np.unique((of.astype(np.int64) << 32) | at)
    return (key & 0xFFFFFFFF).astype(np.int32), np.searchsorted(key >> 32, np.arange(texts + 1))


class Ftrl:
    """Follow the regularised leader, proximal form, with a rate of its own for each coordinate."""

    def __init__(self, rate: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, toxic_weight: float = 2.0):
        self.rate, self.beta, self.l1, self.l2, self.toxic_weight = rate, beta, l1, l2, toxic_weight
        self.z, self.n = np.zeros(COORDINATES), np.zeros(COORDINATES)
        self.bias_z = self.bias_n = 0.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def _bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, bias = self._weights(at), self._bias()
        g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label) * (self.toxic_weight if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.rate * bias
        self.bias_n += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates of non-zero weights, the weights, and the bias."""
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self._weights(at), float(self._bias())


def train(examples: list[tuple[np.ndarray, int]], epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    ftrl = Ftrl()
    for _ in range(epochs):
        for at, label in examples:
            ftrl.learn(at, label)
    return ftrl.model()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most `most` labelled rows outside the held-out fold; without any there are none and the bias is 0."""
    ship(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label, folds, most))
    rows = pick(docs, id=id_col, text=text_col).join(sample, "id").select("id", "label", text_bytes().alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in blocks(batch, "text"):
                at, bounds = distinct(*occurrences(raw, offsets), b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), common.list_array(at, np.diff(bounds), pa.int32())], names=["id", "label", "at"]
                )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            values, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            examples += [(values[offsets[i] : offsets[i + 1]], y) for i, y in enumerate(batch.column(1).to_pylist())]
        at, weights, bias = train([(x, int(y > 0)) for x, y in examples])
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*weights.tolist(), bias], pa.float64())], names=["at", "weight"])

    known = rows.mapInArrow(hashed, "id long, label int, at array<int>").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "at")
    found = known.mapInArrow(learned, "at long, weight double").toArrow()
    at, weight = found.column("at").to_numpy(), found.column("weight").to_numpy()
    return at[at >= 0], weight[at >= 0], float(weight[at < 0].sum())


def scores(raw: np.ndarray, offsets: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text; features without a weight go before the rest are made distinct."""
    at, of = occurrences(raw, offsets)
    weighs = np.flatnonzero((dense != 0)[at])
    texts = len(offsets) - 1
    at, bounds = distinct(at[weighs], of[weighs], texts)
    sums = np.bincount(np.repeat(np.arange(texts), np.diff(bounds)), weights=dense[at], minlength=texts)
    return 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, the probability of label 1) of every row, without a shuffle.

    A null or empty text has no features and gets the bias's score; null ids, repeated rows and texts of any length each
    give a row; an empty table gives none; other columns, even of clashing names, do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, bias = shared.value
        dense = np.zeros(COORDINATES)
        dense[at] = weights
        for batch in batches:
            found = [scores(raw, offsets, dense, bias) for _, _, raw, offsets in blocks(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "score"])

    rows = pick(docs, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
