"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts lie side by side. Splitters are found by counting exact bytes
below candidate boundaries in every partition, and refining the candidates until each splitter meets its tolerance or no
row lies between its bounds any more. Only counts reach the driver: a few for each splitter and round. Then the rows are
exchanged once, into sub-buckets of shards, and numbered there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, pick, ship, text_bytes, written

_LOW = -(1 << 63)
#: Rows between a splitter's bounds that are listed at most, to choose its place among them.
LISTED = 64
#: Buckets that the driver keeps boundaries of at most; beyond, buckets grow instead, and their tasks sort with spill.
MOST_BUCKETS = 1 << 16


@dataclass
class Splitters:
    """Boundaries (high, low), ascending: row belongs to the bucket of the number of boundaries at or below its key."""

    bounds: list[tuple[int, int]]
    rows: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)

    def bucket(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return place(self.bounds, high, low)


def place(bounds: list[tuple[int, int]], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each key, the number of boundaries at or below it."""
    tops = np.array([a for a, _ in bounds], np.int64)
    lows = np.array([b for _, b in bounds], np.int64)
    first, last = np.searchsorted(tops, high, "left"), np.searchsorted(tops, high, "right")
    out = first.copy()
    one = np.flatnonzero(last - first == 1)  # the usual case: a row's high is that of one boundary, or of none
    out[one] += lows[first[one]] <= low[one]
    several = np.flatnonzero(last - first > 1)
    for i in np.unique(first[several]):
        rows = several[first[several] == i]
        out[rows] += np.searchsorted(lows[i : last[rows[0]]], low[rows], "right")
    return out


def count_below(keys: DataFrame, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bytes in each of the len(bounds) + 1 buckets; each partition sends its histogram only."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            at = place(bounds, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, batch.column(2).to_numpy())
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows[some]), pa.array(size[some])], names=["bucket", "n", "size"])

    found = keys.select("high", "low", "size").mapInArrow(histogram, "bucket long, n long, size long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    rows, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in found:
        rows[r["bucket"]], size[r["bucket"]] = r["n"], r["size"]
    return rows, size


def find_splitters(keys: DataFrame, shards: int, parts: int, tolerance: float, by: str = "size", probes: int = 8, whole: bool = False) -> Splitters:
    """Boundaries of shards * parts buckets of nearly equal bytes; a shard's ends are off by `tolerance` of a shard at most,
    a part's by a tenth of a part, wherever single rows allow it. With whole, rows of one `high` stay in one bucket where
    moving the boundary before them shifts it by no more than that."""
    low, high, low_top, high_top, n, total = keys.agg(F.min("low"), F.max("low"), F.min("high"), F.max("high"), F.count(F.lit(1)), F.sum(by)).first()
    wanted = shards * parts - 1
    if not n or wanted <= 0:
        return Splitters([], [n or 0], [total or 0])
    width = high - low + 1
    ends = (0, (high_top - low_top + 1) * width)
    key = lambda x: (min(low_top + x // width, (1 << 63) - 1), low + x % width)
    targets = [total * (j + 1) / (wanted + 1) for j in range(wanted)]
    allowed = [total / shards * tolerance if (j + 1) % parts == 0 else total / (wanted + 1) / 10 for j in range(wanted)]
    bracket = [[ends[0], ends[1], 0, total, 0, n] for _ in range(wanted)]
    final: list[int | None] = [None] * wanted
    while True:
        asked, few = set(), []
        for j in (j for j in range(wanted) if final[j] is None):
            a, b, below_a, below_b, rows_a, rows_b = bracket[j]
            if min(targets[j] - below_a, below_b - targets[j]) <= allowed[j] or b - a <= 1 or rows_b - rows_a <= 1:
                final[j] = a if targets[j] - below_a <= below_b - targets[j] else b
                continue
            if rows_b - rows_a <= LISTED:
                few.append(j)
                continue
            share = (targets[j] - below_a) / max(below_b - below_a, 1)
            guess = a + int((b - a) * share)
            step = max(1, (b - a) // 32)
            asked |= {x for x in (guess, guess - step, guess + step, guess + 1, *(a + (b - a) * i // (probes - 2) for i in range(1, probes - 2))) if a < x < b}
        if not asked:
            _finish(keys, key, few, bracket, targets, final, (low_top, low, width))
            break
        points = sorted(asked)
        rows, size = count_below(keys, [key(x) for x in points])
        below, count = np.cumsum(size)[:-1], np.cumsum(rows)[:-1]
        for j in (j for j in range(wanted) if final[j] is None):
            at = int(np.searchsorted(below, targets[j], "right")) - 1
            for i in (at, at + 1):
                if 0 <= i < len(points):
                    x = points[i]
                    if below[i] <= targets[j] and x > bracket[j][0]:
                        bracket[j][0], bracket[j][2], bracket[j][4] = x, int(below[i]), int(count[i])
                    elif below[i] > targets[j] and x < bracket[j][1]:
                        bracket[j][1], bracket[j][3], bracket[j][5] = x, int(below[i]), int(count[i])
    bounds = [key(x) for x in np.maximum.accumulate(np.array(final, object))]
    rows, size = count_below(keys, bounds)
    if whole:
        before = [(a, _LOW) for a, _ in bounds]
        shift = np.cumsum(size)[:-1] - np.cumsum(count_below(keys, before)[1])[:-1]
        bounds = [b if moved <= most else a for a, b, moved, most in zip(bounds, before, shift.tolist(), allowed, strict=True)]
        rows, size = count_below(keys, bounds)
    return Splitters(bounds, rows.tolist(), size.tolist())


def _finish(keys: DataFrame, key, few: list[int], bracket: list, targets: list[float], final: list, scale: tuple[int, int, int]) -> None:
    """Choose the last boundaries from a listing of the LISTED rows or fewer that lie between the bounds of each."""
    if not few:
        return
    edges: list[int] = []
    for a, b in sorted({(bracket[j][0], bracket[j][1]) for j in few}):
        if edges and a <= edges[-1]:
            edges[-1] = max(edges[-1], b)
        else:
            edges += [a, b]
    bounds = [key(x) for x in edges]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = place(bounds, batch.column(0).to_numpy(), batch.column(1).to_numpy()) % 2 == 1
            yield batch.filter(pa.array(inside))

    low_top, low, width = scale
    found = sorted(((r["high"] - low_top) * width + r["low"] - low, r["size"]) for r in keys.select("high", "low", "size").mapInArrow(listed, "high long, low long, size long").collect())
    for j in few:
        a, b, below, below_b, *_ = bracket[j]
        best = (targets[j] - below, a)
        for x, size in found:
            if a <= x < b:
                best = min(best, (abs(below - targets[j]), x if below > bracket[j][2] else a))
                below += size
        final[j] = min(best, (below_b - targets[j], b))[1]


def id_key(column: str = "id") -> Column:
    """An id as a long; null is the least."""
    return F.coalesce(F.col(column).cast("long"), F.lit(_LOW))


def bucket_column(splitters: Splitters, high: str, low: str) -> Column:
    @F.pandas_udf("int")
    def bucket(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(splitters.bucket(a.to_numpy(), b.to_numpy()).astype(np.int32))

    return bucket(high, low)


def shard(docs: DataFrame, shards: int = 24, part_bytes: int = 256 << 20, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with `size` (UTF-8 bytes of the text, none for null, plus 8), `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard).

    Law "bytes": shards hold nearly equal sums of size, within `tolerance` of a shard and a row's size. Equal texts lie
    side by side, and in one shard if that moves its end by no more than `tolerance`; a larger group may go on in the next.
    Null and empty texts are one group; repeated rows each have a slot; a text of any length is one row of one shard. A shard is sorted in parts of about `part_bytes`,
    one task each, so that the largest task stays as the data grow, up to MOST_BUCKETS parts in all. Rows of equal text and id lie on one side of every boundary.
    Null ids sort first; an empty table gives no rows; the columns added are named _size, _shard and _slot if the input has
    their names, in any case of letters.
    """
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, own = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    size = F.length(text_bytes(text)).cast("long") + 8
    rows = plain.withColumns({"high": F.xxhash64(text_bytes(text)), "low": id_key(own), "size": size})
    keys = written(rows.select("high", "low", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-total // (shards * part_bytes)), MOST_BUCKETS // shards))
    splitters = find_splitters(keys, shards, parts, tolerance, whole=True)
    drop_written(keys)
    base, at = [], 0
    for i, n in enumerate(splitters.rows):
        at = 0 if i % parts == 0 else at
        base.append(at)
        at += n
    placed = rows.withColumn("bucket", bucket_column(splitters, "high", "low")).repartitionById(shards * parts, "bucket")  # a task a bucket: by hash, several would meet in one
    order = Window.partitionBy("bucket").orderBy("high", "low")
    numbered = placed.withColumn("place", F.row_number().over(order).cast("long") - 1)
    numbered = numbered.join(F.broadcast(spark.createDataFrame(list(enumerate(base)), "bucket int, base long")), "bucket")  # shards or MOST_BUCKETS rows at most
    taken = {x.lower() for x in names}
    added = [f"_{x}" if x in taken else x for x in ("size", "shard", "slot")]
    out = numbered.withColumns({"shard": F.floor(F.col("bucket") / parts).cast("int"), "slot": F.col("place") + F.col("base")})
    return out.select(*plain.columns, "size", "shard", "slot").toDF(*names, *added)
