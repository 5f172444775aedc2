"""What the operators share: column picking, tables in the shared folder, and word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once; a longer text is a step of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of a batch that a pipeline stage sends to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes whose words are hashed at once.
_HASHED_BYTES = 1 << 20
#: Parts into which spread_join deals the rows of one key.
SALTS = 256
#: Bytes of batches after which a Python worker returns the memory that it has freed.
_RETURN_BYTES = 8 << 20


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name under new names; other columns, even with names that differ in case only, do no harm."""
    at = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(at))])
    return plain.select(*[F.col(f"c{at.index(name)}").alias(new) for new, name in columns.items()])


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it comes by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def bound_batches(spark: SparkSession) -> None:
    """Batches of bounded bytes for Python workers, unless the session has a bound of its own.

    By rows alone a batch of 10,000 texts is tens of MB, and the JVM's buffers for it and the worker's copies are several times that.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one of our own on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/gistmill-checkpoints-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, buckets: int = 0, by: str = "") -> DataFrame:
    """The rows as a Parquet table in the shared folder: it cuts lineage and outlives lost executors.

    With buckets the rows, which should be dealt by the column `by` into as many partitions, are a bucketed table: joins on
    that column need no exchange of it.
    """
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/gistmill/{own}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffles that led to the table are of no more use
    try:
        if buckets:
            df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(own.replace("-", "_"))
        else:
            df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.table(own.replace("-", "_")) if buckets else spark.read.schema(df.schema).parquet(path)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], row: str, how: str = "inner") -> DataFrame:
    """big joined with small on keys, where one key may hold a third of big's rows; small has a row for each key at most.

    Rows of big are dealt to salts by their column `row`. small first meets the distinct (keys, salt), at most SALTS of a key,
    and these then meet big's rows, so that no task gets a key's whole group.
    """
    salted = big.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    met = salted.select(*keys, "salt").distinct().join(small, keys)
    return salted.join(met, [*keys, "salt"], how).drop("salt")


def tiled(df: DataFrame, key: str, row: str, size: Column, most: int) -> DataFrame:
    """Rows of each key dealt by `row` into tiles of about `most` by the sum of size, and sent to every pair of tiles: tile, i, j.

    A row of tile t comes once for each pair (i, j), i <= j, of which t is one, so two rows of a key meet in one pair at least
    and in one only if their tiles differ. A key of one tile is sent once; no task gets more than two tiles of a key at a time.
    """
    large = df.groupBy(key).agg(F.ceil(F.sum(size) / most).cast("int").alias("tiles")).where("tiles > 1")
    dealt = spread_join(df, large, [key], row, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(row), F.col("tiles")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return sent.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("tiles", "other")


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        folder = file.rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.sql(f"drop table if exists {folder.rsplit('/', 1)[-1].replace('-', '_')}")  # where it is a bucketed one
        break


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes: first row, row after the last, the bytes, and each row's byte offsets."""
    values = batch.column(batch.schema.get_field_index(column))
    n = len(values)
    if n == 0:
        return
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32, count=n + values.offset + 1)[values.offset :].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only


def return_memory() -> None:
    """Give what Arrow and the C library have freed, and keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of Arrow batches or arrays, for workers that return freed memory as they go on and when they end.

    A worker stays for later tasks, idle or not, and what it keeps counts beside the JVM, whose heap may be full by then.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        def fed() -> Iterator:
            held = 0
            for batch in batches:
                if held >= _RETURN_BYTES:
                    return_memory()
                    held = 0
                held += batch.nbytes
                yield batch

        try:
            yield from run(fed())
        finally:
            return_memory()

    return tidied


# ---- word hashing -------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWERED]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, _HASHED_BYTES + (1 << 16))
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for key, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


class Words:
    """Words of a run of texts: 64-bit hashes, byte bounds, and for each text the index of its first word."""

    __slots__ = ("hash", "start", "end", "first", "text_of")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool, hashes: bool = True, apart: np.ndarray = _SPACE):
        n, texts = len(raw), len(offsets) - 1
        if n == 0:
            self.hash, self.start, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.first, self.text_of = np.zeros(texts + 1, np.int64), np.zeros(0, np.int64)
            return
        inside = ~apart[raw]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets, "left")
        self.first[-1] = len(self.start)
        self.text_of = np.repeat(np.arange(texts), np.diff(self.first))
        if hashes:  # a word's hash hangs on its bytes only, so any run of whole words can be hashed apart
            self.hash = np.empty(len(self.start), np.uint64)
            values, at = _LOWER_VALUES if lower else _BYTE_VALUES, 0
            while at < len(self.start):
                low = int(self.start[at])
                to = max(at + 1, int(np.searchsorted(self.end, low + _HASHED_BYTES, "right")))
                high = int(self.end[to - 1])
                up, down = _power_tables(high - low)
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(values[raw[low:high]] * up, dtype=np.uint64, out=sums[1:])
                start, end = self.start[at:to] - low, self.end[at:to] - low
                self.hash[at:to] = splitmix((sums[end] - sums[start]) * down[start])
                at = to


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for each position that has k words after it, across text bounds too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= np.uint64(_MULTIPLIER)
        total += hashes[j : j + n]
    return splitmix(total)


def whole(first: np.ndarray, text_of: np.ndarray, k: int) -> np.ndarray:
    """For each position of grams(): do its k words lie in one text?"""
    n = len(text_of) - k + 1
    return text_of[:n] == text_of[k - 1 :] if n > 0 else np.zeros(0, bool)


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return hashes.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the rows' lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
