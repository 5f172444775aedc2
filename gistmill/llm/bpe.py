"""Byte-level BPE over rank files.

Distinct pieces of a batch are laid out by length in padded matrices. In each round every row merges its leftmost pair of
least rank; pairs are looked up in a hash table in numpy, and the matrix is compacted by one column's shift. A piece over
LONG bytes has a matrix of its own, over whose rows it is folded, and merges in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, returning, ship

#: Longest piece, in bytes, that shares a matrix with others; bounds of the length buckets.
LONG, BUCKETS = 128, (4, 8, 16, 32, 64, 128)
#: Pieces that a worker remembers between batches, and the longest of them.
CACHE, CACHED_BYTES = 300_000, 48
_NONE = np.int64(1) << 40


class Ranks:
    """Ranks of byte strings, and what merging any two of them gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        keys, values = [], []
        for whole, r in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(r)
        self._hash(np.array(keys, np.int64), np.array(values, np.int64))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most an eighth full."""
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 8))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            candidates = left[free]
            _, first = np.unique(slot[candidates], return_index=True)
            placed = candidates[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask
        every = np.arange(256)
        self.of_bytes = self.merged(np.repeat(self.byte_rank[every], 256), np.tile(self.byte_rank[every], 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation; _NONE where there is none. Negative ids stand for padding."""
        key = (a << np.int64(32)) | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], _NONE)
        pending = np.flatnonzero((there != key) & (there != -1))
        while len(pending):
            at = (slot[pending] + 1) & self.mask
            slot[pending] = at
            there = self.keys[at]
            hit = there == key[pending]
            out[pending[hit]] = self.values[at[hit]]
            pending = pending[~hit & (there != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for high in BUCKETS:
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(rows), 8192):
                part = rows[at : at + 8192]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], sizes[part], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._folded(pieces[i])
        for i in np.flatnonzero(sizes == 0):
            out[i] = ()
        return out

    def _matrix(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_rank[raw]
        ids[np.arange(width) >= sizes[:, None]] = -1
        done: list = [None] * n
        rows, length = np.arange(n), sizes.copy()
        pair = self.of_bytes[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]
        pair[np.arange(1, width) >= sizes[:, None]] = _NONE
        while len(rows):
            at = pair.argmin(1)  # the leftmost of the least
            best = pair[np.arange(len(rows)), at]
            over = best >= _NONE
            if over.any():
                for r, row, k in zip(rows[over], ids[over].tolist(), length[over].tolist(), strict=True):
                    done[r] = tuple(row[:k])
                go = ~over
                rows, ids, pair, length, at, best = rows[go], ids[go], pair[go], length[go], at[go], best[go]
                if not len(rows):
                    break
            i = np.arange(len(rows))
            keep = np.ones(ids.shape, bool)
            keep[i, at + 1] = False
            ids[i, at] = best
            ids = ids[keep].reshape(len(rows), -1)
            length = length - 1
            if ids.shape[1] == 1:
                for r, row in zip(rows, ids.tolist(), strict=True):
                    done[r] = tuple(row)
                break
            # the merged pair's column goes; only its two neighbours change
            keep = np.ones(pair.shape, bool)
            keep[i, at] = False
            pair = pair[keep].reshape(len(rows), -1)
            last = ids.shape[1] - 2
            right = np.minimum(at, last)
            pair[i, right] = self.merged(ids[i, right], ids[i, right + 1])
            left = np.maximum(at - 1, 0)
            pair[i, left] = self.merged(ids[i, left], ids[i, left + 1])
            most = int(length.max())
            if most < ids.shape[1]:
                ids, pair = ids[:, : max(most, 2)], pair[:, : max(most, 2) - 1]
        return done

    def _folded(self, piece: bytes, width: int = LONG) -> tuple[int, ...]:
        """A long piece folded over rows of a matrix: each round merges its leftmost pair of least rank and compacts one row.

        The least rank of each row is kept, so a round looks at those and at the rows next to the merge only.
        """
        n = len(piece)
        rows = -(-n // width)
        ids, pair = np.full(rows * width, -1, np.int64), np.full(rows * width, _NONE)
        ids[:n] = self.byte_rank[np.frombuffer(piece, np.uint8)]
        pair[: n - 1] = self.merged(ids[: n - 1], ids[1:n])
        ids, pair = ids.reshape(rows, width), pair.reshape(rows, width)
        size, after, before = [width] * (rows - 1) + [n - (rows - 1) * width], list(range(1, rows + 1)), list(range(-1, rows - 1))
        least = pair.min(1)
        rank = lambda x, y: self.ranks.get(self.bytes_of[x] + self.bytes_of[y], _NONE)
        while True:
            row = int(least.argmin())
            best = int(least[row])
            if best >= _NONE:
                return tuple(ids[ids >= 0].tolist())
            at = int(pair[row].argmin())
            ids[row, at] = best
            cut, place = (row, at + 1) if at + 1 < size[row] else (after[row], 0)
            for x, empty in ((ids, -1), (pair, _NONE)):
                x[cut, place:-1] = x[cut, place + 1 :]
                x[cut, -1] = empty
            size[cut] -= 1
            if not size[cut]:
                after[before[cut]] = after[cut]
                if after[cut] < rows:
                    before[after[cut]] = before[cut]
                least[cut] = _NONE
            right = ids[row, at + 1] if at + 1 < size[row] else ids[after[row], 0] if after[row] < rows else None
            pair[row, at] = _NONE if right is None else rank(best, right)
            behind, last = (row, at - 1) if at else (before[row], size[before[row]] - 1)
            if behind >= 0:
                pair[behind, last] = rank(ids[behind, last], best)
            for x in {row, cut, behind}:
                if x >= 0:
                    least[x] = pair[x].min()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_ranks_of(spark: SparkSession, path: str) -> dict[bytes, int]:
    """read_ranks() by Spark's readers, for a file on a shared store."""
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in spark.read.text(path).collect() if r[0].strip())}


#: The pattern that most texts meet, and for texts of plain Latin script an equal one for `re`, which is faster.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_PATTERN = r""" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"""
_beyond_latin = re.compile(r"[^\x00-\x1b\x20-\x84\x86-±´-¸º»¿-ɏ‐-‧]").search


class Coder:
    """Splits, encodes and decodes; remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = Ranks(ranks)
        self.split = general = regex.compile(pattern, regex.V1).findall
        if pattern == COMMON_PATTERN:
            latin = re.compile(LATIN_PATTERN).findall
            self.split = lambda text: general(text) if _beyond_latin(text) else latin(text)
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        found = [self.split(t) for t in texts]
        pieces = set().union(*found)
        new = [p for p in pieces if p not in self.cache]
        self.cache.update(zip(new, self.table.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        out = [list(chain.from_iterable(map(get, x))) for x in found]
        if len(self.cache) > CACHE:  # what this batch used stays, the rest goes
            self.cache = {p: self.cache[p] for p in pieces if len(p) <= CACHED_BYTES}
        else:
            for p in new:
                if len(p) > CACHED_BYTES:
                    del self.cache[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.bytes_of.__getitem__, ids))


_coders: dict = {}


def coder(key: tuple, ranks: dict[bytes, int], pattern: str) -> Coder:
    """One a process and vocabulary."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def _groups(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every text, and the text decoded from them; one row a document, no shuffle.

    vocabulary is the path of a rank file that the driver can read; its ranks, some 50,000 entries, are broadcast. Returns
    id_col, n_tokens, ids (array of int) and decoded (string); with digests, instead of the last two, ids_sha256 (of the
    decimal ids joined by a blank) and decoded_sha256. A null text is empty; an empty text has no ids; null ids, repeated
    rows and texts of any length each give a row; an empty table gives none; other columns, even of clashing names, do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    key = (vocabulary, pattern)

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(key, ranks.value, pattern)
        text_of = own.table.text_of.__getitem__
        for batch in batches:
            for part in _groups(batch):
                ids = own.encode_all([t or "" for t in part.column(1).to_pylist()])
                plain = [own.decode(x) for x in ids]
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64())]
                if digests:
                    cols.append(pa.array([hashlib.sha256(" ".join(map(text_of, x)).encode()).hexdigest() for x in ids], pa.string()))
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string()))
                else:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    cols.append(pa.array([x.decode("utf-8", "replace") for x in plain], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    schema = "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
