"""Document fingerprints from prefix polynomial hashes.

The modular prefix array of a text answers whether any two spans are equal, and binary search over it finds the longest
common extension of two places. A fingerprint keeps the length, the hash of the whole, and the hashes of the prefixes and
suffixes whose lengths are on a fixed geometric grid; two fingerprints alone tell, by binary search over the grid, how far
their texts agree from the start and from the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharding
from .common import drop_written, ship, text_bytes, written

#: Two prime moduli under 2**31 and their bases.
MODULI, BASES = (2147483647, 2147483629), (1000003, 999983 * 2)
#: Lengths of prefixes and suffixes that a fingerprint hashes: all to 16, then six an octave.
GRID = np.array(sorted({*range(1, 17), *(int(16 * 2 ** (i / 6)) for i in range(1, 6 * 27))}), np.int64)

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse, n at least; made by doubling."""
    if k not in _tables or len(_tables[k][0]) < n:
        size, p = 1 << max(12, math.ceil(math.log2(max(n, 2)))), np.uint64(MODULI[k])
        both = []
        for base in (BASES[k], pow(BASES[k], -1, MODULI[k])):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), MODULI[k])) % p])
            both.append(out)
        _tables[k] = both[0], both[1]
    return _tables[k]


def codes(text: str) -> np.ndarray:
    """Code points, plus one."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix arrays of a text under both moduli."""

    __slots__ = ("n", "sums")

    def __init__(self, points: np.ndarray, start: PrefixHash | None = None, keep: int = 0):
        """With start, its first `keep` points stand before the given ones and are not hashed again."""
        self.n = keep + len(points)
        self.sums = []
        for k, p in enumerate(MODULI):
            up, _ = _powers(k, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            base = np.uint64(0)
            if start is not None:
                sums[: keep + 1] = start.sums[k][: keep + 1]
                base = sums[keep]
            np.cumsum(points * up[keep : self.n] % np.uint64(p), out=sums[keep + 1 :])
            sums[keep + 1 :] += base
            sums[keep + 1 :] %= np.uint64(p)
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans; equal spans have equal ones wherever they lie."""
        out = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(MODULI):
            _, down = _powers(k, self.n + 1)
            part = (self.sums[k][ends] + np.uint64(p) - self.sums[k][starts]) % np.uint64(p) * down[starts] % np.uint64(p)
            out = (out << np.uint64(31)) | part
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The longest common extension: how many code points from i in a and from j in b on are equal."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


class Fingerprint:
    __slots__ = ("n", "whole", "prefixes", "suffixes")

    def __init__(self, hashed: PrefixHash):
        n = self.n = hashed.n
        grid = GRID[: np.searchsorted(GRID, n, "right")]
        k = len(grid)
        starts = np.concatenate([np.zeros(k + 1, np.int64), n - grid])
        ends = np.concatenate([[n], grid, np.full(k, n)])
        found = hashed.spans(starts, ends)
        self.whole = int(found[0])
        short = ((found ^ (found >> np.uint64(29))) & np.uint64(0xFFFFFF)).astype(np.int64)
        self.prefixes, self.suffixes = short[1 : k + 1], short[k + 1 :]

    def __str__(self) -> str:
        text = lambda x: x.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
        return f"{self.n:x}-{self.whole:016x}-{text(self.prefixes)}-{text(self.suffixes)}"


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """The largest length on the grid up to which both agree, by binary search: agreement on a length means on all shorter."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return int(GRID[low - 1]) if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The share of the longer text on which both agree from their ends, as far as the grid tells; 1 for equal texts."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    shared = min(_agree(a.prefixes, b.prefixes) + _agree(a.suffixes, b.suffixes), min(a.n, b.n))
    return min(shared / max(a.n, b.n), 1 - 1e-9)


_SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket come in order, then the first row of the next one."""
    held = None
    out: list = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        out.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for bucket, ahead, own, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                points = codes(text)
                hashed = PrefixHash(points)
                print_ = Fingerprint(hashed)
                if held is not None and held[0] == bucket:
                    out.append(_compared(*held[1:], text, points, print_))
                held = None if ahead else (bucket, own, text, hashed, print_)
            if len(out) >= 512:
                yield flush()
    yield flush()


def _compared(own, text: str, hashed: PrefixHash, print_: Fingerprint, after: str, points: np.ndarray, after_print: Fingerprint) -> tuple:
    n = hashed.n
    tail = n // 4
    edited = text[: n - tail] + after[:tail]
    edited_print = Fingerprint(PrefixHash(points[:tail], hashed, n - tail)) if tail else print_
    return own, n, hashlib.sha256(edited.encode()).hexdigest(), str(print_), str(edited_print), likeness(print_, edited_print), likeness(print_, after_print)


def compare_neighbours(docs: DataFrame, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; one row a document, one exchange of the texts.

    The next document is that of the next id (ties by the text's hash), after the last the first; the edited text has its
    last floor(n/4) code points replaced by the first as many, or all, of the next one's. Buckets of neighbouring ids, of
    about bucket_bytes each (or more, if sharding.MOST_BUCKETS don't suffice), come from a histogram of the ids; the first row of each bucket goes to the one before too.
    A null text is empty; two empty texts are alike (1), an empty and another are not (0); null ids come first; repeated
    rows each give a row; a single row is its own neighbour; an empty table gives none; other columns, even of clashing
    names, do no harm; a text of any length has its prefix arrays in memory at once, 16 bytes a code point.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(at))])
    text, own = f"c{at.index(text_col)}", f"c{at.index(id_col)}"
    rows = plain.select(F.col(own).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), sharding.id_key(own).alias("high"), F.xxhash64(text_bytes(text)).alias("low"))
    keys = written(rows.select("high", "low", (F.length("text") + 64).cast("long").alias("size")), "neighbour-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, min(-(-total // bucket_bytes), sharding.MOST_BUCKETS))
    splitters = sharding.find_splitters(keys, 1, buckets, 0.1)
    bucketed = keys.withColumn("bucket", sharding.bucket_column(splitters, "high", "low"))
    heads = sorted((r["bucket"], r["head"]["high"], r["head"]["low"]) for r in bucketed.groupBy("bucket").agg(F.min(F.struct("high", "low")).alias("head")).collect())
    drop_written(keys)
    before = {heads[i][1:]: heads[i - 1][0] for i in range(len(heads))}  # at most one head a bucket

    @F.pandas_udf("int")
    def ahead_of(a, b):
        import pandas as pd

        return pd.Series([before.get(x, -1) for x in zip(a.tolist(), b.tolist(), strict=True)], dtype="int32")

    rows = rows.withColumns({"bucket": sharding.bucket_column(splitters, "high", "low"), "ahead_of": ahead_of("high", "low")})
    own_place = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead"))
    other_place = F.struct(F.col("ahead_of").alias("bucket"), F.lit(1).alias("ahead"))
    places = rows.select("id", "text", "high", "low", F.explode(F.when(F.col("ahead_of") >= 0, F.array(own_place, other_place)).otherwise(F.array(own_place))).alias("place"))
    sent = places.select(F.col("place.bucket").alias("bucket"), F.col("place.ahead").alias("ahead"), "id", "text", "high", "low").repartition(2 * buckets, "bucket").sortWithinPartitions("bucket", "ahead", "high", "low")
    return sent.select("bucket", "ahead", "id", "text").mapInArrow(_pairs, _SCHEMA).withColumnRenamed("id", id_col)
