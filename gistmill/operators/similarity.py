"""Cosine similarity of sentences in a docset, from sparse vectors, and the graph of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of sentences, and products of pairs, that half_edges() holds at once.
BLOCK = 2_000_000


def half_edges(s: np.ndarray, c: np.ndarray, w: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, cosine of the pairs i < j of n sparse vectors that share a term and reach the threshold, ordered by i and j. Entries
    (vector s, term c, weight w) come ordered by s. Only blocks of rows are held, never all pairs."""
    norm = np.sqrt(np.bincount(s, w * w, n))
    kept = norm[s] > 0
    s, c, u = s[kept], c[kept], w[kept] / norm[s[kept]]
    order = np.argsort(c, kind="stable")  # a term's entries together, by vector
    others, unit = s[order], u[order]
    last = np.append(np.flatnonzero(np.diff(c[order])) + 1, len(c)) if len(c) else np.zeros(0, int)
    end = np.repeat(last, np.diff(last, prepend=0))
    place = np.empty(len(c), np.int64)
    place[order] = np.arange(len(c))
    begin = place + 1
    count = end[place] - begin  # of an entry, the later vectors that hold its term
    until = np.searchsorted(s, np.arange(n + 1))
    work = np.append(0, np.cumsum(count))[until]
    found, a = [], 0
    while a < n:
        b = max(a + 1, min(int(np.searchsorted(work, work[a] + BLOCK, "right")) - 1, a + BLOCK // (n - a)))
        x = slice(until[a], until[b])
        many = count[x]
        total = int(many.sum())
        if total:
            at = np.repeat(begin[x] - (np.cumsum(many) - many), many) + np.arange(total)
            key = np.repeat((s[x] - a) * (n - a) - a, many) + others[at]
            block = np.bincount(key, np.repeat(u[x], many) * unit[at], (b - a) * (n - a))
            hit = block >= threshold
            if threshold <= 0:
                hit &= np.bincount(key, minlength=len(block)) > 0
            hit = np.flatnonzero(hit)
            found.append((hit // (n - a) + a, hit % (n - a) + a, block[hit]))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cosine_edges(vectors: DataFrame, threshold: float = 0.0) -> DataFrame:
    """docset_id, i, j, w of both directions of every pair i <> j with w >= threshold. Nodes are (doc_id, sent_idx) structs.

    A docset's vectors meet in one task, which holds blocks of its pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("sent_idx", "ascending")]).combine_chunks()
        doc, sent = table["doc_id"].to_numpy(), table["sent_idx"].to_numpy()
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(sent) != 0))
        s, first = np.cumsum(new) - 1, np.flatnonzero(new)
        i, j, w = half_edges(s, table["term"].combine_chunks().dictionary_encode().indices.to_numpy(), table["w"].to_numpy(), len(first), threshold)
        node = lambda x: pa.StructArray.from_arrays([pa.array(doc[first[x]], pa.int64()), pa.array(sent[first[x]], pa.int32())], ["doc_id", "sent_idx"])
        both = lambda x, y: np.concatenate([x, y])
        return pa.table({"docset_id": pa.repeat(table["docset_id"][0], 2 * len(i)), "i": node(both(i, j)), "j": node(both(j, i)), "w": both(w, w)})

    node = "struct<doc_id: bigint, sent_idx: int>"
    return vectors.select("docset_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_idx").cast("int").alias("sent_idx"), "term", F.col("w").cast("double").alias("w")).groupBy("docset_id").applyInArrow(run, f"docset_id string, i {node}, j {node}, w double")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("docset_id", "i").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def column_normalized(edges: DataFrame) -> DataFrame:
    """Each weight over the sum of its column."""
    total = F.sum("w").over(Window.partitionBy("docset_id", "j"))
    return edges.withColumn("share", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")))


#: Vectors of a group that one side of a tile has, about.
TILE = 2048


def dense_pairs(rows: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """i, j, w of every pair i < j of keys of a group whose dense vectors have a cosine of threshold (above 0) or more.

    All pairs are computed, in tiles: a task holds two tiles of vectors and their products, however large a group is.
    """
    kinds = dict(rows.dtypes)
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    sides = -(-most // TILE)
    own = rows.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(max(sides, 1))).cast("int").alias("own"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(max(sides, 1) - 1)), lambda t: F.struct(F.least("own", t).alias("a"), F.greatest("own", t).alias("b")))
    tiles = own.withColumn("t", F.explode(meet)).select("g", "t.a", "t.b", "own", "k", "v")

    def run(table: pa.Table) -> pa.Table:
        k, own = table["k"].to_numpy(), table["own"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(k), -1)
        norm = np.sqrt((v * v).sum(1))
        v = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
        same = table["a"][0].as_py() == table["b"][0].as_py()
        left = np.flatnonzero(own == table["a"][0].as_py())
        right = left if same else np.flatnonzero(own != table["a"][0].as_py())
        found = []
        for begin in range(0, len(left), 256):
            mine = left[begin : begin + 256]
            w = v[mine] @ v[right].T
            x, y = np.nonzero(w >= threshold)
            a, b, w = k[mine[x]], k[right[y]], w[x, y]
            kept = a < b if same else a != b
            found.append((np.minimum(a, b)[kept], np.maximum(a, b)[kept], w[kept]))
        i, j, w = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (k[:0], k[:0], np.zeros(0))
        return pa.table({"i": i, "j": j, "w": w})

    return tiles.groupBy("g", "a", "b").applyInArrow(run, f"i {kinds[key]}, j {kinds[key]}, w double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Of dense arrays; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors of an array whose mask is 1; all zeros where none is."""
    places = lambda x: F.sequence(F.lit(0), F.size(x) - 1)
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    total = lambda d: F.aggregate(places(mask), F.lit(0.0), lambda s, t: s + F.get(mask, t) * F.get(F.get(vectors, t), d))
    return F.transform(places(F.get(vectors, F.lit(0))), lambda d: total(d) / n)


def reduce_vectors(vectors: DataFrame, group: str, how: str = "centroid") -> DataFrame:
    """group, dim, value: centroid (mean), normalized_mean or normalized_sum of the group's vectors (column v)."""
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    rows = vectors.select(group, "v", F.when(norm > 0, norm).otherwise(1.0).alias("norm")).select(group, "norm", F.posexplode("v").alias("dim", "x"))
    by = {"centroid": F.avg(F.col("x").cast("double")), "normalized_mean": F.avg(F.col("x") / F.col("norm")), "normalized_sum": F.sum(F.col("x") / F.col("norm"))}
    if how not in by:
        raise ValueError(f"how is one of {', '.join(by)}")
    return rows.groupBy(group, "dim").agg(by[how].alias("value"))
