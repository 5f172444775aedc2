"""LexRank: centrality of sentences in a docset's similarity graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.similarity import half_edges


@dataclass(frozen=True)
class Config:
    threshold: float = 0.15
    error: float = 1e-10
    dampening: float = 0.15
    min_length: int = 7
    min_jaccard_dist: float = 0.7
    max_iterations: int = 10_000
    mode: str = "documented"

    def __post_init__(self):
        if self.mode not in ("documented", "as_implemented"):
            raise ValueError("mode is documented or as_implemented")


class Walk:
    """The walk over a docset's n sentences along edges i < j of weight w. Documented rows are divided by their sums (a node
    without edges leads everywhere), as_implemented ones by the number of nodes. Only edges are held, never a matrix."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, mode: str = "documented"):
        self.n = n
        start, end, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
        order = np.argsort(end, kind="stable")
        self.start, self.w, sizes = start[order].astype(np.int32), w[order], np.bincount(end, minlength=n)
        self.led = np.flatnonzero(sizes)  # nodes that edges lead to
        self.begin = (np.cumsum(sizes) - sizes)[self.led]
        total = np.zeros(n)
        total[self.led] = np.add.reduceat(self.w, self.begin) if len(self.w) else 0.0
        self.loose = total == 0 if mode == "documented" else np.zeros(n, bool)
        self.w = self.w / (total[self.start] if mode == "documented" else n)

    def step(self, p: np.ndarray, dampening: float) -> np.ndarray:
        got = np.zeros(self.n)
        if len(self.w):
            got[self.led] = np.add.reduceat(self.w * p[self.start], self.begin)
        return dampening * p.sum() / self.n + (1 - dampening) * (got + p[self.loose].sum() / self.n)

    def fixed(self, steps: int, dampening: float = 0.15) -> np.ndarray:
        """Scores over the largest after so many steps."""
        p = np.full(self.n, 1 / self.n)
        for _ in range(steps):
            p = self.step(p, dampening)
        return p / p.max()

    def converged(self, config: Config) -> np.ndarray:
        """Scores over the largest; one node gets 1."""
        p = np.full(self.n, 1 / self.n)
        for _ in range(config.max_iterations):
            new = self.step(p, config.dampening)
            done = np.linalg.norm(new - p) < config.error
            p = new
            if done:
                break
        return p / p.max()


def by_rank(scores: np.ndarray) -> np.ndarray:
    """Places by falling score, ties by place."""
    return np.lexsort((np.arange(len(scores)), -np.round(scores, 9)))


def fixed_iterations(nodes: DataFrame, edges: DataFrame, iterations: int, dampening: float = 0.15, mode: str = "documented") -> DataFrame:
    """docset_id, i, score after so many steps. nodes: docset_id, i; edges: docset_id, i, j, w, both directions. See Walk."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        if not len(nodes):
            return nodes.append_column("score", pa.array([], pa.float64()))
        place = {(r["doc_id"], r["sent_idx"]): k for k, r in enumerate(nodes["i"].to_pylist())}
        at = lambda name: np.array([place[r["doc_id"], r["sent_idx"]] for r in edges[name].to_pylist()], np.int64)
        i, j = at("i"), at("j")
        half = i < j
        walk = Walk(len(nodes), i[half], j[half], edges["w"].to_numpy()[half], mode)
        return pa.table({"docset_id": nodes["docset_id"], "i": nodes["i"], "score": walk.fixed(iterations, dampening)})

    node = "struct<doc_id: bigint, sent_idx: int>"
    fresh = lambda *x: [F.col(c).alias(c) for c in x]  # noqa: E731  both may stem from one table
    return nodes.select(*fresh("docset_id", "i")).groupBy("docset_id").cogroup(edges.select(*fresh("docset_id", "i", "j", "w")).groupBy("docset_id")).applyInArrow(run, f"docset_id string, i {node}, score double")


def converged(vectors: DataFrame, nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """docset_id, doc_id, sent_idx, score, iterated to convergence; a docset's sentences and edges meet in one task.

    vectors: docset_id, doc_id, sent_idx, term, w; nodes: all sentences, also those without a vector.
    """
    return grid(vectors, nodes, [config]).drop("setting")


def grid(vectors: DataFrame, nodes: DataFrame, configs: list[Config]) -> DataFrame:
    """setting (the place of a configuration), docset_id, doc_id, sent_idx, score: converged() under each configuration, from
    the similarities of a docset."""

    def rank(nodes: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(nodes):
            return pa.table({"setting": pa.array([], pa.int32()), **{c: nodes[c] for c in ("docset_id", "doc_id", "sent_idx")}, "score": pa.array([], pa.float64())})
        nodes = nodes.sort_by([("doc_id", "ascending"), ("sent_idx", "ascending")])
        place = {k: at for at, k in enumerate(zip(nodes["doc_id"].to_pylist(), nodes["sent_idx"].to_pylist(), strict=True))}
        s = np.array([place[k] for k in zip(vectors["doc_id"].to_pylist(), vectors["sent_idx"].to_pylist(), strict=True)], np.int64)
        order = np.argsort(s, kind="stable")
        c = vectors["term"].combine_chunks().dictionary_encode().indices.to_numpy()[order] if len(s) else s
        out, n = [], len(nodes)
        for k, config in enumerate(configs):
            scores = Walk(n, *half_edges(s[order], c, vectors["w"].to_numpy()[order], n, config.threshold), mode=config.mode).converged(config)
            out.append(nodes.select(["docset_id", "doc_id", "sent_idx"]).add_column(0, "setting", pa.array(np.full(n, k, np.int32))).append_column("score", pa.array(scores)))
        return pa.concat_tables(out)

    keys = [F.col("docset_id").alias("docset_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_idx").cast("int").alias("sent_idx")]
    rows = vectors.select(*keys, "term", F.col("w").cast("double").alias("w"))
    return nodes.select(*keys).groupBy("docset_id").cogroup(rows.groupBy("docset_id")).applyInArrow(rank, "setting int, docset_id string, doc_id long, sent_idx int, score double")


def ranked(scores: DataFrame, by: tuple[str, ...] = ("docset_id",)) -> DataFrame:
    """rank from 0 by falling score, ties by place."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "doc_id", "sent_idx")
    return scores.withColumn("rank", F.row_number().over(order) - 1)
