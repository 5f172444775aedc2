"""Benchmark decontamination: rare n-gram seeds find places in training texts, Smith-Waterman alignment scores them.

Words are runs of letters and digits, lower-cased, so case and punctuation do not matter. A text that holds a seed of an item
is aligned with the item around that place: +1 for an equal word, -1 for another or a missing one. The score is the best
alignment's sum over the item's words. Items are taken in blocks of bounded size, each of which is broadcast; the corpus is
read once a block to count and once to match.

Seeds are word pairs, the rarest by counts over the whole corpus, and as many of them as lose no leak. An alignment of m equal
words and e edits that sums up to t = m - e lies in e + 1 runs of equal words at most, so m - e - 1 = t - 1 of the item's n - 1
pairs or more stand in the text as they are. Of any n - t + 1 pairs one is then among those, even if others occur nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, grams, pick, returning, ship, splitmix, text_bytes
from .toxicity import _APART as APART

#: Words of a seed, of the shortest item that is searched for, and the least score of a leak.
SEED_WORDS, LEAST_WORDS, LEAST_SCORE = 2, 3, 0.5
#: Places of seeds that one step of a search takes at once.
_STEP = 2_000_000
#: Words of items that one broadcast block holds at most (a longer item is a block of its own).
BLOCK_WORDS = 500_000
#: Bits of the table that n-grams pass before they are looked up.
_FILTER_BITS = 23


class Items:
    """A block of items: their words, their n-grams and, once these are counted, their seeds."""

    def __init__(self, ids: list, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        words = Words(raw, np.cumsum([0, *map(len, texts)]).astype(np.int64), lower=True, apart=APART)
        self.ids, self.words, self.first = ids, words.hash if len(raw) else np.zeros(0, np.uint64), words.first
        self.size = np.diff(self.first)
        item_of = np.repeat(np.arange(len(ids)), self.size)
        hashes = grams(self.words, SEED_WORDS)
        at = np.flatnonzero(item_of[: len(hashes)] == item_of[SEED_WORDS - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        at = at[self.size[item_of[at]] >= LEAST_WORDS]
        self.gram, self.gram_item, self.gram_at = hashes[at], item_of[at], at - self.first[item_of[at]]
        self.keys = np.unique(self.gram)
        self.own = np.unique(splitmix(self.words ^ splitmix(item_of.astype(np.uint64) + np.uint64(7))))
        self._set_seeds(np.ones(len(self.gram), bool))

    def _set_seeds(self, keep: np.ndarray) -> None:
        order = np.argsort(self.gram[keep], kind="stable")
        self.seed, self.seed_item, self.seed_at = self.gram[keep][order], self.gram_item[keep][order], self.gram_at[keep][order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def least_sum(self, least: float) -> np.ndarray:
        """The least sum of an alignment with each item that gives it the score `least`."""
        return np.ceil(least * self.size - 1e-9).astype(np.int64)

    def choose(self, counts: np.ndarray, least: float) -> Items:
        """Keep each item's rarest n-grams, as many as a leak of score `least` can't do without; counts are those of self.keys."""
        order = np.lexsort((counts[np.searchsorted(self.keys, self.gram)], self.gram_item))
        item = self.gram_item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = np.zeros(len(self.gram), bool)
        keep[order] = rank < (self.size - self.least_sum(least) + 1)[item]
        self._set_seeds(keep)
        return self

    def _passing(self, words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = grams(words.hash, SEED_WORDS)
        at = np.flatnonzero(table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = at[words.text_of[at] == words.text_of[at + SEED_WORDS - 1]]
        return at, hashes[at]

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How often each of self.keys occurs in the texts."""
        words = Words(raw, offsets, lower=True, apart=APART)
        if not len(words.start) or not len(self.keys):
            return np.zeros(len(self.keys), np.int64)
        _, hashes = self._passing(words, self.filter)
        place = np.searchsorted(self.keys, hashes)
        place = place[self.keys[np.minimum(place, len(self.keys) - 1)] == hashes]
        return np.bincount(place, minlength=len(self.keys))

    def match(self, raw: np.ndarray, offsets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score) of each pair whose best alignment scores `least` or more."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        words = Words(raw, offsets, lower=True, apart=APART)
        if not len(words.start) or not len(self.seed):
            return none
        at, hashes = self._passing(words, self.filter)
        low, high = np.searchsorted(self.seed, hashes, "left"), np.searchsorted(self.seed, hashes, "right")
        times = high - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        if not len(at):
            return none
        found = [self._leaks(words, at[part], low[part], times[part], least) for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(times) // _STEP)) + 1)]
        text, item, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = text * len(self.ids) + item
        order = np.lexsort((-scores, pair))
        keep = order[np.append(True, np.diff(pair[order]) != 0)] if len(order) else order
        return text[keep], item[keep], scores[keep]

    def _leaks(self, words: Words, at: np.ndarray, low: np.ndarray, times: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score) of alignments that score `least` or more, around the seeds at places `at`, each with `times` seeds from `low` on."""
        place = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        item, text = self.seed_item[place], words.text_of[at]
        diagonal = at - self.seed_at[place]
        # an alignment with more missing words on either side would sum up to less
        slack = np.maximum(self.size - self.least_sum(least), 0)
        # one alignment for seeds of a text and an item whose diagonals are close
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > 4 + slack[item[1:]] // 2)
        start = np.flatnonzero(first)
        last = np.append(start[1:], len(text)) - 1
        text, item, low, high = text[start], item[start], diagonal[start], diagonal[last]
        low = np.maximum(low - slack[item], words.first[text])
        high = np.minimum(high + self.size[item] + slack[item], words.first[text + 1])
        scores = np.zeros(len(text))
        for part in np.array_split(np.argsort(high - low, kind="stable"), max(1, int((high - low).sum() // 400_000))):
            scores[part] = self._align(words.hash, low[part], high[part], item[part], least)
        good = scores >= least
        return text[good], item[good], scores[good]

    def _align(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, least: float) -> np.ndarray:
        """Scores of windows against their items. A window with too few of the item's words, a bound on the score, is not aligned."""
        out = np.zeros(len(low))
        if not len(low):
            return out
        width = int((high - low).max())
        column = low[:, None] + np.arange(width)
        inside = column < high[:, None]
        window = words[np.minimum(column, len(words) - 1)]
        key = splitmix(window ^ splitmix(item.astype(np.uint64) + np.uint64(7))[:, None])
        place = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
        able = np.flatnonzero(((self.own[place] == key) & inside).sum(1) >= least * self.size[item])
        if not len(able):
            return out
        window, inside, size, begin = window[able], inside[able], self.size[item[able]], self.first[item[able]]
        steps = np.arange(width, dtype=np.int32)
        before, best = np.zeros((len(able), width), np.int32), np.zeros(len(able), np.int32)
        for i in range(int(size.max())):
            alive = i < size
            word = self.words[np.minimum(begin + i, len(self.words) - 1)]
            step = np.where((window == word[:, None]) & inside, 1, -1).astype(np.int32)
            row = step
            row[:, 1:] += before[:, :-1]
            np.maximum(row, before - 1, out=row)
            np.maximum(row, 0, out=row)
            row = np.maximum.accumulate(row + steps, axis=1) - steps  # gaps in the item
            row[~inside] = 0
            row[~alive] = 0
            np.maximum(best, row.max(1), out=best)
            before = row
        out[able] = best / size
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of at most `most` words or so; the driver holds one block at a time."""
    ids, texts, held = [], [], 0
    for row in pick(benchmark, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_bytes().alias("text")).orderBy("id").toLocalIterator():
        text = bytes(row["text"])
        words = len(text) // 2 + 1
        if held and held + words > most * 3:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["id"]), texts.append(text)
        held += words
    if ids:
        yield Items(ids, texts)


def seeded(docs: DataFrame, items: Items, least: float = LEAST_SCORE) -> Items:
    """The block with its seeds chosen by counts over all of `docs` (columns id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @returning
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            for _, _, raw, offsets in blocks(batch, "text"):
                total += shared.value.count(raw, offsets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.keys), np.int64)
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return items.choose(counts, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_id and score (0 to 1) of each text and item whose best alignment scores `least` or more; no shuffle of texts.

    Null and empty texts match nothing, nor do items of fewer than LEAST_WORDS words; equal items each match; null ids,
    repeated rows and texts of any length each are searched; without items or documents there are no rows; other columns of
    either table, even of clashing names, do no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_bytes().alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col):
        found = _matched(rows, seeded(rows, items, least), least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "id long, item_id long, score double")
    return out.withColumnRenamed("id", id_col)


def _matched(rows: DataFrame, items: Items, least: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in blocks(batch, "text"):
                text, item, score = shared.value.match(raw, offsets, least)
                ids = [shared.value.ids[i] for i in item]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(text)), pa.array(ids, pa.int64()), pa.array(score)], names=["id", "item_id", "score"])

    return rows.mapInArrow(run, "id long, item_id long, score double")


def leak_score(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> Column:
    """A column of docs, whose names must be distinct, with the best score of any item, 0 under `least`; for a filter without a join."""
    ship(docs.sparkSession)
    rows = pick(docs, text=text_col).select(text_bytes().alias("text"))
    total: Column = F.lit(0.0)
    for items in item_blocks(benchmark):
        total = F.greatest(total, _scorer(rows, seeded(rows, items, least), least)(text_bytes(text_col)))
    return total


def _scorer(rows: DataFrame, items: Items, least: float):
    shared = rows.sparkSession.sparkContext.broadcast(items)

    @F.arrow_udf("double")
    @returning
    def best(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            out = np.zeros(len(texts))
            for a, _, raw, offsets in blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
                text, _, score = shared.value.match(raw, offsets, least)
                np.maximum.at(out, a + text, score)
            yield pa.array(out)

    return best
