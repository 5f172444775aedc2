"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays of features and thresholds; a row's path is found by numpy for all rows of a
block at once. The trees are fitted on the driver from the statistics (not the texts) of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, pick, returning, ship, text_bytes

#: Labelled rows that a classifier is fitted on at most: those whose hashed ids are least.
SAMPLE_ROWS = 20_000

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "other_space", "stop", "comma", "quote", "bang", "pipe", "symbol", "lead", "rest", "control")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
_CLASS[:32] = _CLASSES.index("control")
_CLASS[127] = _CLASSES.index("control")
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32], _CLASS[10], _CLASS[[9, 11, 12, 13]] = 3, 4, 5
for _name, _chars in (("stop", b".?"), ("comma", b",;:-"), ("quote", b"'\"()"), ("bang", b"!"), ("pipe", b"|")):
    _CLASS[list(_chars)] = _CLASSES.index(_name)
_CLASS[128:192], _CLASS[192:] = _CLASSES.index("rest"), _CLASSES.index("lead")

STATISTICS = (
    "log_bytes", "log_words", "log_lines", *(f"share_{x}" for x in _CLASSES), "word_mean", "word_deviation", "word_longest",
    "short_words", "long_words", "distinct_words", "distinct_lines", "line_words", "stops_a_word", "odd_ends", "upper_starts",
)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    sizes = np.diff(offsets)
    words = Words(raw, offsets, lower=True)
    count = np.diff(words.first)
    kind = _CLASS[raw]
    shares = np.zeros((n, len(_CLASSES)))
    lines = np.zeros((n, 2))
    for i in np.flatnonzero(sizes):
        a, b = offsets[i], offsets[i + 1]
        shares[i] = np.bincount(kind[a:b], minlength=len(_CLASSES))
        found = raw[a:b].tobytes().split(b"\n")
        lines[i] = len(found), len(set(found))
    has, some = np.maximum(sizes, 1), np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    per = lambda x: np.bincount(words.text_of, weights=x, minlength=n)[:n]
    mean = per(length) / some
    longest = np.zeros(n)
    np.maximum.at(longest, words.text_of, length)
    if len(length):
        key = (words.hash >> np.uint64(24)) | (words.text_of.astype(np.uint64) << np.uint64(40))
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
        ends, starts = _CLASS[raw[words.end - 1]], _CLASS[raw[words.start]]
        odd = per(np.isin(ends, [_CLASSES.index(x) for x in ("symbol", "bang", "pipe", "control")]).astype(float))
        upper = per((starts == 1).astype(float))
        short, long = per((length <= 3).astype(float)), per((length > 14).astype(float))
    else:
        distinct = odd = upper = short = long = np.zeros(n)
    columns = [
        np.log1p(sizes), np.log1p(count), np.log1p(lines[:, 0]), *(shares / has[:, None]).T, mean, np.sqrt(np.maximum(per(length**2) / some - mean**2, 0)), longest,
        short / some, long / some, distinct / some, lines[:, 1] / np.maximum(lines[:, 0], 1), count / np.maximum(lines[:, 0], 1), shares[:, 6] / some, odd / some, upper / some,
    ]
    for j, x in enumerate(columns):
        out[:, j] = x
    return out


class Trees:
    """Boosted complete trees of one depth, as arrays: node i has the children 2i+1 and 2i+2."""

    def __init__(self, depth: int = 4, rounds: int = 80, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.smooth, self.least = depth, rounds, rate, bins, smooth, least
        self.base, self.feature, self.bound, self.leaf = 0.0, np.zeros((0, 1), np.int32), np.zeros((0, 1)), np.zeros((0, 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """No rows, or rows of one class, give a constant."""
        n, columns = x.shape
        p = (y.sum() + 0.5) / (n + 1.0)
        self.base = float(np.log(p / (1 - p)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        if n == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(columns)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(columns)])
        logit = np.full(n, self.base)
        features, bounds, values = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-logit))
            gradient, curve = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, bound = np.zeros(inner, np.int32), np.full(inner, np.inf)
            for level in range(self.depth):
                nodes, first = 2**level, 2**level - 1
                best, where, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, -1)
                for j in range(columns):
                    if not len(cuts[j]):
                        continue
                    at, width = node * self.bins + binned[j], nodes * self.bins
                    g = np.bincount(at, gradient, width).reshape(nodes, -1)
                    h = np.bincount(at, curve, width).reshape(nodes, -1)
                    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    all_g, all_h = g.sum(1)[:, None], h.sum(1)[:, None]
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + self.smooth) + right_g**2 / (right_h + self.smooth) - all_g**2 / (all_h + self.smooth)
                    gain[(left_h < self.least) | (right_h < self.least)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(nodes), top]
                    better = value > best + 1e-9
                    best[better], where[better], cut[better] = value[better], j, top[better]
                for k in np.flatnonzero(cut >= 0):
                    feature[first + k], bound[first + k] = where[k], cuts[where[k]][cut[k]]
                go = (cut[node] >= 0) & (binned[where[node], np.arange(n)] > cut[node])
                node = 2 * node + go
            g, h = np.bincount(node, gradient, leaves), np.bincount(node, curve, leaves)
            value = -self.rate * g / (h + self.smooth)
            logit += value[node]
            features.append(feature), bounds.append(bound), values.append(value)
        self.feature, self.bound, self.leaf = np.stack(features), np.stack(bounds), np.stack(values)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n = len(x)
        total, rows = np.full(n, self.base), np.arange(n)
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(n, np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def bucket_of(id_col: Column, buckets: int) -> Column:
    """crc32 of an id as text, modulo `buckets`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % buckets


def labelled_sample(labels: DataFrame, label: str, folds: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` rows (id, label) outside the held-out fold, those of the least hashed ids; nulls are left out."""
    rows = pick(labels, id=id_col, label=label).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = rows.where(bucket_of(F.col("id"), folds) != 0).select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(most)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in blocks(batch, "text"):
            x = statistics(raw, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"]
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, most: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most `most` labelled rows outside the held-out fold; without any, a constant of one half."""
    ship(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label, folds, most))
    rows = pick(docs, id=id_col, text=text_col).join(sample, "id").select(text_bytes().alias("text"), "label")
    found = rows.mapInArrow(_statistics_rows, "label int, x array<double>").toArrow()
    y = found.column("label").to_numpy().astype(float)
    flat = found.column("x").combine_chunks()
    x = (flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    return Trees().fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1, the probability of label 1) of every row, without a shuffle.

    Null texts count as empty and get a score; null ids, repeated rows and texts of any length each give a row; an empty
    table gives none; other columns, even of clashing names, do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(statistics(raw, offsets)) for _, _, raw, offsets in blocks(batch, "text")]
            values = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "score"])

    rows = pick(docs, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score_column(spark: SparkSession, trees: Trees, text: Column) -> Column:
    """The score of UTF-8 bytes as a column, for a filter that keeps every other column and joins nothing."""
    ship(spark)
    model = spark.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    @returning
    def scored(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:  # as Arrow has them: a copy as Python objects would be as large again
            found = [model.value.score(statistics(raw, offsets)) for _, _, raw, offsets in blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return scored(text)
