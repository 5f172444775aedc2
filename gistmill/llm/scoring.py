"""Language-model scoring by context-tree weighting over bytes.

The tree holds every context of training up to trees.DEPTH bytes, whatever its count, so it grows with the corpus. Texts are
read once and dealt, where they lie, into chunks; a chunk asks for each of its distinct grams (a context and the byte after
it) and for each distinct word once, with its counts in training. Asks are packed into buckets by hash, grams by the nearest
bytes of their contexts, so that a bucket's grams make up whole subtrees. A bucket's asks are added up as they stream by, its
subtrees are weighted, and what remains above them (contexts of two bytes or fewer) is a table of bounded size. The same
asks then meet the finished model, bucket by bucket, and the answers meet the chunk's texts. No key has more rows than there
are chunks, and a task holds a bucket's model or a chunk, never all of either.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import Words, blocks, drop_written, pick, ship, splitmix, text_bytes, written
from .quality import bucket_of

#: Kinds of packed rows: texts, asks for grams, asks for words; of a model's rows also nodes of the top and totals of words.
TEXTS, GRAMS, WORDS, NODES, TOTALS = range(5)
#: Grams that are weighted at once, and asks that are added up at once.
_SLICE, _HELD = 200_000, 2_000_000
_PACKED = "chunk long, kind int, bucket int, keys binary, counts binary"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


# ---- chunks and what they ask for ---------------------------------------------------------------------------------


def _packed_texts(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _asked(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts among those of training, 0 for others."""
    keys, counts = np.unique(values[training], return_counts=True)
    others = np.unique(values[~training])
    return trees.merged([(keys, counts), (others, np.zeros(len(others), np.int64))])


class Asks:
    """Distinct grams and words of a chunk, added up as its texts come by, with their counts in those texts that teach."""

    def __init__(self):
        self.parts: dict[int, list] = {GRAMS: [], WORDS: []}
        self.held = 0

    def add(self, raw: np.ndarray, offsets: np.ndarray, training: np.ndarray) -> None:
        teaches, at = np.repeat(training, np.diff(offsets) + 1), 0
        for keys in trees.gram_pieces(raw, offsets):
            self._hold(GRAMS, _asked(keys, teaches[at : at + len(keys)]))
            at += len(keys)
        if len(raw):
            words = Words(raw, offsets, lower=True)
            self._hold(WORDS, _asked(words.hash, training[words.text_of]))

    def _hold(self, kind: int, asked: tuple[np.ndarray, np.ndarray]) -> None:
        self.parts[kind].append(asked)
        self.held += len(asked[0])
        if self.held > _HELD:
            self.parts = {k: [trees.merged(x)] if x else [] for k, x in self.parts.items()}
            self.held = sum(len(x[0][0]) for x in self.parts.values() if x) // 2


def _buckets_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = splitmix(trees.subtree_of(keys)) if kind == GRAMS else keys
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask_rows(chunk: int, asks: Asks, buckets: int) -> list[tuple]:
    out = []
    for kind, parts in asks.parts.items():
        if not parts:
            continue
        keys, counts = trees.merged(parts)
        bucket = _buckets_of(kind, keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out += [(chunk, kind, b, trees.pack(keys[edge[b] : edge[b + 1]]), trees.pack(counts[edge[b] : edge[b + 1]])) for b in np.flatnonzero(np.diff(edge)).tolist()]
    return out


def _deal(chunk_bytes: int, buckets: int):
    """Texts (id, held_out, text) to packed texts and asks. Chunks are numbered by partition, so a task run again gives the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, asks = TaskContext.get().partitionId() << 32, 0, Asks()
        for batch in batches:
            for a, b, raw, offsets in blocks(batch, "text"):
                part = batch.slice(a, b - a)
                yield _batch([(chunk, TEXTS, None, _packed_texts(pa.RecordBatch.from_arrays([pa.concat_arrays([x]) for x in part.columns], schema=part.schema)), None)], _PACKED)
                asks.add(raw, offsets, ~part.column(1).to_numpy(zero_copy_only=False).astype(bool))
                size += len(raw)
                if size >= chunk_bytes:
                    yield _batch(_ask_rows(chunk, asks, buckets), _PACKED)
                    chunk, size, asks = chunk + 1, 0, Asks()
        if asks.parts[GRAMS]:
            yield _batch(_ask_rows(chunk, asks, buckets), _PACKED)

    return run


# ---- the model ----------------------------------------------------------------------------------------------------

_MODEL = "kind int, bucket int, keys binary, counts binary"


def _weighed(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of a bucket's subtrees: grams with their decisions' probabilities, and the nodes of their roots."""
    subtree = trees.subtree_of(keys)
    at = 0
    while at < len(keys):
        end = int(np.searchsorted(subtree, subtree[min(at + _SLICE, len(keys)) - 1], "right"))
        made = trees.Subtrees(keys[at:end], counts[at:end])
        yield GRAMS, bucket, trees.pack(keys[at:end]), made.ones.astype(np.float32).tobytes()
        roots = [x.astype(np.int64) for x in made.roots[:4]]
        # nodes of one parent and place add up
        where, row = np.unique((roots[0] >> 8) * 255 + roots[1], return_inverse=True)
        sums = [np.bincount(row, weights=x, minlength=len(where)) for x in (roots[2], roots[3], made.roots[4])]
        yield NODES, None, where.tobytes(), np.concatenate(sums).tobytes()
        at = end


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks sorted by kind and bucket to the model's rows."""
    key, parts, held = None, [], 0

    def finished() -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        keys, counts = trees.merged(parts)
        if key[0] == GRAMS:
            for row in _weighed(key[1], keys, counts):
                yield _batch([row], _MODEL)
        else:
            some = counts > 0
            yield _batch([(WORDS, key[1], trees.pack(keys[some]), trees.pack(counts[some])), (TOTALS, None, None, np.array([some.sum(), counts.sum()], np.int64).tobytes())], _MODEL)

    for batch in batches:
        for kind, bucket, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (kind, bucket):
                yield from finished()
                key, parts, held = (kind, bucket), [], 0
            parts.append((trees.unpack(k), trees.unpack(c, np.int64)))
            held += len(parts[-1][0])
            if held > _HELD:
                parts = [trees.merged(parts)]
                held = len(parts[0][0]) // 2
    yield from finished()


def _sum_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of a task added up to one: at most 65,536 contexts of two bytes with 255 nodes each."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            where, sums = np.frombuffer(k, np.int64), np.frombuffer(c, float).reshape(3, -1)
            if held:
                where, row = np.unique(np.append(held["at"], where), return_inverse=True)
                both = np.concatenate([held["sums"], sums], 1)
                sums = np.stack([np.bincount(row, weights=x, minlength=len(where)) for x in both])
            held = {"at": where, "sums": sums}
    if held:
        yield _batch([(held["at"].tobytes(), held["sums"].tobytes())], "keys binary, counts binary")


def _top(model: DataFrame) -> trees.Top:
    nodes = model.where(f"kind = {NODES}").select("keys", "counts")
    for parts in (32, 1):
        nodes = nodes.coalesce(parts).mapInArrow(_sum_nodes, "keys binary, counts binary")
    found = nodes.first()
    where, sums = (np.frombuffer(found[0], np.int64), np.frombuffer(found[1], float).reshape(3, -1)) if found else (np.zeros(0, np.int64), np.zeros((3, 0)))
    return trees.Top(where // 255, where % 255, *sums)


# ---- answers and scores -------------------------------------------------------------------------------------------


def _answer(top):
    """The model's rows of a bucket, then asks for it: (chunk, kind, keys, values), log10 of grams' probabilities and counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, model = None, [], None
        for batch in batches:
            out = []
            for kind, bucket, chunk, k, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != (kind, bucket):
                    key, known, model = (kind, bucket), [], None
                keys = trees.unpack(k)
                if chunk < 0:
                    known.append((keys, top.value.log10(keys, np.frombuffer(c, np.float32).reshape(-1, 8)) if kind == GRAMS else trees.unpack(c, np.int64)))
                    continue
                if model is None:
                    model = tuple(np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    order = np.argsort(model[0], kind="stable")
                    model = model[0][order], model[1][order]
                at = np.searchsorted(model[0], keys)
                if kind == GRAMS:
                    out.append((chunk, kind, k, model[1][at].astype(np.float32).tobytes()))
                else:  # words of held-out texts may be unknown
                    there = at < len(model[0])
                    there[there] = model[0][at[there]] == keys[there]
                    values = np.zeros(len(keys), np.int64)
                    values[there] = model[1][at[there]]
                    out.append((chunk, kind, k, trees.pack(values)))
            if out:
                yield _batch(out, "chunk long, kind int, keys binary, counts binary")

    return run


def _scores_of_chunk(key: tuple, packed: pa.Table, answers: pa.Table) -> pa.Table:
    found: dict[int, list] = {GRAMS: [], WORDS: []}
    for kind, k, v in zip(*(answers.column(x).to_pylist() for x in ("kind", "keys", "counts")), strict=True):
        found[kind].append((trees.unpack(k), np.frombuffer(v, np.float32) if kind == GRAMS else trees.unpack(v, np.int64)))
    table = {kind: trees.Lookup(*(np.concatenate(x) for x in zip(*parts, strict=True))) for kind, parts in found.items() if parts}
    rows = []
    for data in packed.column("keys").to_pylist():
        for batch in pa.ipc.open_stream(data):
            for a, b, raw, offsets in blocks(batch, "text"):
                part = batch.slice(a, b - a)
                sums = lambda values, bounds: np.diff(np.append(0.0, np.cumsum(values, dtype=float))[np.clip(bounds, 0, len(values))])
                score, at = np.zeros(b - a), 0
                for keys in trees.gram_pieces(raw, offsets):
                    score += sums(table[GRAMS](keys), offsets + np.arange(len(offsets)) - at)
                    at += len(keys)
                words = Words(raw, offsets, lower=True)
                counts = table[WORDS](words.hash) if len(words.start) else np.zeros(0, np.int64)
                base = sums(np.log10(counts + 0.1), words.first)
                known = sums(counts > 0, words.first).astype(np.int64)
                rows.append((part.column(0), part.column(1), np.diff(words.first), known, base, score))
    cols = list(zip(*rows, strict=True))
    flat = [pa.chunked_array(x) for x in cols[:2]] + [pa.array(np.concatenate(x)) for x in cols[2:]]
    return pa.table(dict(zip(("id", "held_out", "n_words", "n_known", "base", "score"), flat, strict=True)))


def score(docs: DataFrame, folds: int = 10, chunk_bytes: int = 32 << 20, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base score and tree score of every text, learned from the texts outside the held-out fold.

    Returns id_col, held_out, n_tokens (words and the end), n_known, train_tokens, base_score and score, both log10 of
    probabilities; score is that of the text's bytes, A-Z lower-cased, and its end. A null text is empty: its only token is
    the end. Null ids count as the empty text for the fold; repeated rows each give a row and each teach; with nothing to
    learn from, train_tokens is 0 and the tree gives every decision one half; an empty table gives no rows; other columns,
    even of clashing names, do no harm. The code length of each byte of a text of any length is looked up, never cut short;
    a text longer than chunk_bytes makes its chunk longer. Words are told apart by 64-bit hashes. There are as many buckets
    as bucket_bytes of text, 4096 at most, since a bucket's model grows more slowly than the corpus.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), (bucket_of(F.col("id"), folds) == 0).alias("held_out"), text_bytes().alias("text"))
    total, teaching = rows.agg(F.sum(F.length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    chunks, buckets = max(1, -(-(total or 0) // chunk_bytes)), min(4096, max(1, -(-(total or 0) // bucket_bytes)))
    dealt = written(rows.mapInArrow(_deal(chunk_bytes, buckets), _PACKED), "dealt")
    asks = dealt.where(f"kind <> {TEXTS}")
    by_bucket = lambda df, *more: df.repartition(2 * buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket", *more)
    model = written(by_bucket(asks.select("kind", "bucket", "keys", "counts")).mapInArrow(_learn, _MODEL), "model")
    top = spark.sparkContext.broadcast(_top(model))  # 65,793 contexts at most
    distinct, words = (sum(x) for x in zip((0, 0), *(np.frombuffer(r[0], np.int64).tolist() for r in model.where(f"kind = {TOTALS}").select("counts").collect()), strict=True))  # a row a bucket
    learned = model.where(f"kind in ({GRAMS}, {WORDS})").select("kind", "bucket", F.lit(-1).cast("long").alias("chunk"), "keys", "counts")
    met = learned.unionByName(asks.select("kind", "bucket", "chunk", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = by_bucket(met, "chunk").mapInArrow(_answer(top), "chunk long, kind int, keys binary, counts binary")
    parts = 4 * chunks  # more than chunks, so that few meet others by hash
    answers = answers.repartition(parts, "chunk")
    texts = dealt.where(f"kind = {TEXTS}").select("chunk", "keys").repartition(parts, "chunk")
    found = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores_of_chunk, "id long, held_out boolean, n_words long, n_known long, base double, score double")
    # each text has one end more, a token that training has met once a text
    tokens, distinct, ends = words + (teaching or 0), distinct + bool(teaching), teaching or 0
    unit = float(np.log10(tokens + 0.1 * (distinct + 1)))
    n_tokens = F.col("n_words") + 1
    base = F.col("base") + F.lit(float(np.log10(ends + 0.1))) - n_tokens * F.lit(unit)
    return found.select(F.col("id").alias(id_col), "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + int(bool(ends))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
