"""Ordering of chosen sentences by topic clusters and fractional positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_positions(clustered: DataFrame, how: str = "median") -> DataFrame:
    """docset_id, cluster, cluster_frac, n: the median or mean fraction of the cluster's distinct sentences."""
    by = {"median": F.median("frac"), "mean": F.avg("frac")}
    if how not in by:
        raise ValueError("how is median or mean")
    distinct = clustered.groupBy("docset_id", "cluster", "sentence").agg(F.min("frac").alias("frac"))
    return distinct.groupBy("docset_id", "cluster").agg(by[how].alias("cluster_frac"), F.count(F.lit(1)).alias("n"))


def order_summary(chosen: DataFrame, clustered: DataFrame, how: str = "median") -> DataFrame:
    """The chosen sentences (docset_id, sentence, place) that a cluster has, each once, and their place in the new order."""
    positions = cluster_positions(clustered, how)
    known = clustered.groupBy("docset_id", "sentence").agg(F.min(F.struct("cluster", "frac")).alias("k")).select("docset_id", "sentence", "k.cluster", "k.frac")
    once = chosen.groupBy("docset_id", "sentence").agg(F.min("place").alias("place"))
    met = once.join(known, ["docset_id", "sentence"]).join(positions.drop("n"), ["docset_id", "cluster"])
    order = Window.partitionBy("docset_id").orderBy("cluster_frac", "cluster", "frac", "place")
    return met.withColumn("order_idx", F.row_number().over(order) - 1)


def in_order(chosen: dict[str, int], placed: list[tuple[str, int, float]]) -> list[tuple[str, int, int]]:
    """Sentence, cluster and place of a docset's chosen sentences (with their places) in the new order, as order_summary() gives
    them for placed (sentence, cluster, frac)."""
    least, known = {}, {}
    for sentence, cluster, frac in placed:
        least[cluster, sentence] = min(frac, least.get((cluster, sentence), frac))
        if sentence in chosen:
            known[sentence] = min((cluster, frac), known.get(sentence, (cluster, frac)))
    of: dict[int, list[float]] = {}
    for (cluster, _), frac in least.items():
        of.setdefault(cluster, []).append(frac)
    middle = {cluster: float(np.median(x)) for cluster, x in of.items()}
    return [(s, c, p) for _, c, _, p, s in sorted((middle[c], c, frac, chosen[s], s) for s, (c, frac) in known.items())]


def lloyd(points: np.ndarray, k: int = 8, starts: int = 10, iterations: int = 300, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Cluster of each point, from k-means++ starts, the best of them; clusters are numbered by their first point."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    if k <= 1:
        return np.zeros(len(points), np.int64)
    random, best, best_cost = np.random.default_rng(seed), None, np.inf
    scale = tolerance * points.var(0).mean()
    squares = (points**2).sum(1)
    far = lambda c: np.maximum(squares[:, None] - 2 * points @ c.T + (c**2).sum(1), 0)
    for _ in range(starts):
        centres = points[[random.integers(len(points))]]
        while len(centres) < k:
            d = far(centres).min(1)
            centres = np.vstack([centres, points[random.choice(len(points), p=d / d.sum()) if d.sum() > 0 else random.integers(len(points))]])
        for _ in range(iterations):
            own = far(centres).argmin(1)
            inside = (own[:, None] == np.arange(k)).astype(float)
            size = inside.sum(0)
            moved = np.where(size[:, None] > 0, inside.T @ points / np.maximum(size, 1)[:, None], centres)
            shift = ((moved - centres) ** 2).sum()
            centres = moved
            if shift <= scale:
                break
        d = far(centres)
        own, cost = d.argmin(1), d.min(1).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = own, cost
    _, first, back = np.unique(best, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[back]


def kmeans(vectors: DataFrame, group: str, key: str, k: int = 8, seed: int = 0) -> DataFrame:
    """group, key, cluster of the dense vectors (column v) of each group; one group is one task's matrix."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        rows["cluster"] = lloyd(np.stack(rows.v.to_numpy()).astype(float), k, seed=seed)
        return rows[[group, key, "cluster"]]

    kinds = dict(vectors.dtypes)
    return vectors.select(group, key, "v").groupBy(group).applyInPandas(assign, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


def positions_before(sents: DataFrame) -> DataFrame:
    """previous: the sentence before in its document."""
    return sents.withColumn("previous", F.lag("sentence").over(Window.partitionBy("docset_id", "doc_id").orderBy("sent_idx")))
