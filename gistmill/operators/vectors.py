"""Vectors of sentences: LSA by truncated SVD, word vectors, and encoders that a user plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Vectors up to which all singular directions are computed; beyond that the first ones by a block Krylov space.
DENSE = 400


def project(s: np.ndarray, c: np.ndarray, w: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have entries (vector s, ordered; term c, weight w), and their projections on the first singular
    directions, signed by the largest entry of each. Memory follows the entries, not vectors times terms."""
    at, s = np.unique(s, return_inverse=True)
    terms, c = np.unique(c, return_inverse=True)
    n, m = len(at), len(terms)
    if not n:
        return at, np.zeros((0, 0))
    rows = np.searchsorted(s, np.arange(n))
    order = np.argsort(c, kind="stable")
    s_of, w_of, columns = s[order], w[order], np.searchsorted(c[order], np.arange(m))
    times = lambda x: np.add.reduceat(w[:, None] * x[c], rows, axis=0)
    back = lambda y: np.add.reduceat(w_of[:, None] * y[s_of], columns, axis=0)
    k = min(n, m, rank)
    if min(n, m) <= DENSE:
        if n <= m:
            near = np.zeros((n, n))
            for a in range(0, n, 64):
                part = np.zeros((m, min(64, n - a)))
                x = slice(rows[a], rows[a + 64] if a + 64 < n else len(s))
                part[c[x], s[x] - a] = w[x]
                near[:, a : a + 64] = times(part)
            y = np.linalg.eigh(near)[1][:, ::-1][:, :k]
        else:
            dense = np.zeros((n, m))
            dense[s, c] = w
            y = np.linalg.svd(dense, full_matrices=False)[0][:, :k]
    else:
        y = leading(lambda y: times(back(y)), n, k)
    vt = back(y)  # directions times singular values
    sign = np.sign(vt[np.abs(vt).argmax(0), np.arange(k)])
    return at, y * np.linalg.norm(vt, axis=0) * np.where(sign == 0, 1, sign)


def leading(apply, n: int, k: int, tolerance: float = 1e-9, most: int = 60) -> np.ndarray:
    """The k first eigenvectors of a symmetric operator of size n without negative eigenvalues, by restarted block Krylov spaces;
    a block is wider than k, so equal eigenvalues are all met."""
    width, depth = k + 8, 12
    if width * 3 >= n:
        return np.linalg.eigh(apply(np.eye(n)))[1][:, ::-1][:, :k]
    depth = min(depth, n // width)
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0]
    for _ in range(most):
        basis, images, q = [], [], block
        for _ in range(depth):
            for _ in range(2):
                for b in basis:
                    q = q - b @ (b.T @ q)
                q = np.linalg.qr(q)[0]
            basis.append(q)
            q = apply(q)
            images.append(q)
        v, image = np.hstack(basis), np.hstack(images)
        small = v.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        y = y[:, ::-1][:, :width]
        block = v @ y
        left = np.linalg.norm(image @ y[:, :k] - block[:, :k] * values[::-1][:k], axis=0)
        if (left <= tolerance * max(values[-1], 1e-300)).all():
            break
    return block[:, :k]


def lsa(vectors: DataFrame, rank: int = 100) -> DataFrame:
    """docset_id, doc_id, sent_idx, v: projections of sparse vectors on the first singular directions of their docset.

    Signs are fixed by the largest entry of each direction. A docset's entries meet in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "sent_idx", "term"])
        keys = rows[["docset_id", "doc_id", "sent_idx"]].drop_duplicates().reset_index(drop=True)
        at = rows.groupby(["doc_id", "sent_idx"], sort=True).ngroup().to_numpy()
        keys["v"] = list(project(at, pd.factorize(rows.term, sort=True)[0], rows.w.to_numpy(float), rank)[1])
        return keys

    return vectors.groupBy("docset_id").applyInPandas(run, "docset_id string, doc_id long, sent_idx int, v array<double>")


def sentence_vectors_from_words(terms: DataFrame, word_vectors: DataFrame, reduction: str = "centroid") -> DataFrame:
    """docset_id, doc_id, sent_idx, v by a lookup of each term in word_vectors (term, v); terms without one are left out."""
    from gistmill.operators.similarity import dot

    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    by = {"centroid": (F.avg, F.lit(1.0)), "normalized_mean": (F.avg, norm), "normalized_sum": (F.sum, norm)}
    if reduction not in by:
        raise ValueError(f"reduction is one of {', '.join(by)}")
    fold, over = by[reduction]
    met = terms.join(word_vectors, "term").select("docset_id", "doc_id", "sent_idx", F.when(over > 0, over).otherwise(1.0).alias("norm"), "v").select("docset_id", "doc_id", "sent_idx", "norm", F.posexplode("v").alias("dim", "x"))
    each = met.groupBy("docset_id", "doc_id", "sent_idx", "dim").agg(fold(F.col("x") / F.col("norm")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return each.groupBy("docset_id", "doc_id", "sent_idx").agg(F.transform(packed, lambda s: s["x"]).alias("v"))


def encoded(sents: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None) -> DataFrame:
    """Sentences with the vectors of an encoder that the user brings; no model comes with the library."""
    if encoder is None:
        raise NotImplementedError("no sentence encoder is available; pass one: list of str -> array of floats")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.tolist()), float)))

    return sents.withColumn("v", run("sentence"))


#: Names of the ways to make sentence vectors.
STRATEGIES = {"lsa": lsa, "words": sentence_vectors_from_words, "encoder": encoded}
