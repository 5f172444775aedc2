"""Substring deduplication by seed and extend.

Winnowing picks anchors: of every 8 neighbouring word 6-grams the one of least hash. Every run of 13 words holds 8 such
grams, so equal runs hold an equal anchor at an equal place. Anchors that two texts share are found first. Around each of
them the match is extended both ways, to the windows of 13 words for which it is the anchor; a window found in a document
of smaller id is a repeat, and overlapping repeats add up to maximal ones, whose words go.

Within a task, an anchor or window of several documents is known to be shared at once: its occurrences need no meeting
with others and are dealt evenly, and one row stands for them all, so no key has more rows than there are batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, drop_written, grams, list_array, pick, ship, splitmix, spread_join, text_bytes, written

#: Words of a window, of an anchor, and the grams of which one is an anchor.
WINDOW, ANCHOR = 13, 6
CHOICE = WINDOW - ANCHOR + 1
_FILTER_BITS = 22


def _chosen(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows that lie in one text, each one's anchor place, and the hashes of all grams."""
    hashes = grams(words.hash, ANCHOR)
    if len(words.hash) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    view = np.lib.stride_tricks.sliding_window_view(hashes, CHOICE)
    start = np.flatnonzero(words.text_of[: len(view)] == words.text_of[WINDOW - 1 : WINDOW - 1 + len(view)])
    return start, start + view[start].argmin(1), hashes


def _kept(raw: np.ndarray, words: Words, a: int, b: int, keep: np.ndarray) -> bytes:
    """Those of words a to b that are kept, joined by one space."""
    text = raw.tobytes() if b - a and (b - a) * 200 > len(raw) else None
    cut = (lambda s, e: text[s:e]) if text is not None else (lambda s, e: raw[s:e].tobytes())
    start, end = words.start[a:b][keep], words.end[a:b][keep]
    return b" ".join(map(cut, start.tolist(), end.tolist()))


def _digest(hashes: np.ndarray) -> np.ndarray:
    """128 bits of a sequence of words."""
    return np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in blocks(batch, "text"):
            words = Words(raw, offsets, lower=False)
            first = words.first.tolist()
            digests = np.array([_digest(words.hash[first[i] : first[i + 1]]) for i in range(b - a)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(words.first)), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["id", "n", "d1", "d2"])


def _dealt(places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly and meet no other."""
    return splitmix(splitmix(ids.view(np.uint64)) + places.view(np.uint64)).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, id, place) of each anchor; place is the word at which it starts. A row without an id stands for known ones."""
    seen: set[bytes] = set()
    for batch in batches:
        keys, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, raw, offsets in blocks(batch, "text"):
            words = Words(raw, offsets, lower=False)
            start, at, hashes = _chosen(words)
            if not len(at):
                continue
            at = at[np.append(True, at[1:] != at[:-1])]
            fresh = np.zeros(b - a, bool)
            for i in np.flatnonzero(np.diff(words.first) >= WINDOW):
                own = _digest(words.hash[words.first[i] : words.first[i + 1]]).tobytes()
                fresh[i] = own not in seen
                if len(seen) < 1_000_000:
                    seen.add(own)
            at = at[fresh[words.text_of[at]]]
            text = words.text_of[at]
            keys.append(hashes[at]), ids.append(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)[text]), places.append(at - words.first[text])
        key, own, place = np.concatenate(keys).view(np.int64), np.concatenate(ids).astype(np.int64), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key, own, place = key[order], own[order], place[order]
        same = key[1:] == key[:-1]
        several = np.append(False, same) | np.append(same, False)
        stand = key[several & np.append(True, ~same)] if len(key) else key
        key = np.where(several, _dealt(place, own), key)
        cols = np.concatenate([key, stand]), np.concatenate([own, np.zeros(len(stand), np.int64)]), np.concatenate([place, np.full(len(stand), -1)]), np.concatenate([several, np.zeros(len(stand), bool)])
        for at in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in cols], names=["deal", "id", "place", "known"])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by deal: known ones and those that another row meets."""
    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.append(x, y) for x, y in zip(held[:4], cols, strict=True)]
        same = cols[0][1:] == cols[0][:-1]
        emit = np.append(False, same) | np.append(same, False) | cols[3].astype(bool)
        given = held is not None and held[4]
        now = emit.copy()
        if given:
            now[0] = False
        held = [x[-1:] for x in cols] + [bool(emit[-1]) or (given and len(cols[0]) == 1)]
        now &= cols[2] >= 0
        yield pa.RecordBatch.from_arrays([pa.array(cols[1][now]), pa.array(cols[2][now], pa.int64())], names=["id", "place"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, owner, window): windows around shared anchors. With a window given, it is a repeat; else deal is the window."""
    for batch in batches:
        owners, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b, raw, offsets in blocks(batch, "text"):
            words = Words(raw, offsets, lower=False)
            start, at, _ = _chosen(words)
            if not len(start):
                continue
            places = batch.column(2).slice(a, b - a)
            flat, counts = places.flatten().to_numpy(), np.diff(places.offsets.to_numpy())
            known = np.zeros(len(words.hash), bool)
            wanted = flat + np.repeat(words.first[:-1], counts)
            inside = wanted < np.repeat(words.first[1:], counts)  # of another text of the same id, maybe
            known[wanted[inside]] = True
            start = start[known[at]]
            windows.append(grams(words.hash, WINDOW)[start])
            owners.append(batch.column(0).slice(a, b - a).to_numpy()[words.text_of[start]])
        window, owner = np.concatenate(windows).view(np.int64), np.concatenate(owners)
        order = np.lexsort((owner, window))
        window, owner = window[order], owner[order]
        if not len(window):
            continue
        first = np.append(True, window[1:] != window[:-1])
        least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
        repeat = (owner > least) & np.append(True, (window[1:] != window[:-1]) | (owner[1:] != owner[:-1]))
        for keys, own, given in ((window[first], owner[first], None), (_dealt(window[repeat], owner[repeat]), owner[repeat], window[repeat])):
            for i in range(0, len(keys), 100_000):
                part = pa.array(given[i : i + 100_000]) if given is not None else pa.nulls(len(keys[i : i + 100_000]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(own[i : i + 100_000]), part], names=["deal", "owner", "window"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by deal and owner: (owner, window) of known repeats and of windows that a smaller owner has too."""
    key = least = None
    for batch in batches:
        deal, owner, window = (batch.column(i) for i in range(3))
        given = window.is_valid().to_numpy(zero_copy_only=False)
        deal, owner = deal.to_numpy(), owner.to_numpy()
        if not len(deal):
            continue
        first = np.append(True, deal[1:] != deal[:-1])
        lowest = owner[np.flatnonzero(first)]
        if key == deal[0]:
            lowest[0] = least
        lowest = lowest[np.cumsum(first) - 1]
        key, least = deal[-1], lowest[-1]
        out = given | (owner > lowest)
        windows = np.where(given, window.fill_null(0).to_numpy(), deal)
        yield pa.RecordBatch.from_arrays([pa.array(owner[out]), pa.array(windows[out])], names=["owner", "window"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept_text) of rows (id, text, repeats, copied): windows that are repeats and digests of the id's texts that are copies."""
    for batch in batches:
        for a, b, raw, offsets in blocks(batch, "text"):
            words = Words(raw, offsets, lower=False)
            windows = grams(words.hash, WINDOW).view(np.int64)
            (flat, bounds), (digests, ends) = ((x.flatten().to_numpy(), np.cumsum([0, *np.diff(x.offsets.to_numpy())])) for x in (batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)))
            removed, kept = [], []
            for i in range(b - a):
                x, y = words.first[i], words.first[i + 1]
                if ends[i] < ends[i + 1] and _digest(words.hash[x:y])[0] in digests[ends[i] : ends[i + 1]]:
                    removed.append(int(y - x)), kept.append(b"")
                    continue
                if bounds[i] == bounds[i + 1]:
                    removed.append(0), kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].tobytes().split()))
                    continue
                here = np.flatnonzero(np.isin(windows[x : max(x, y - WINDOW + 1)], flat[bounds[i] : bounds[i + 1]]))
                edges = np.zeros(y - x + 1, np.int64)
                np.add.at(edges, here, 1)
                np.add.at(edges, here + WINDOW, -1)
                keep = np.cumsum(edges)[:-1] == 0
                removed.append(int((~keep).sum())), kept.append(_kept(raw, words, x, y, keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"]
            )


def _bits(ids: DataFrame) -> np.ndarray:
    """A bounded table of hashed ids; it lets every given id pass, and few others while the ids are few."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS)).cast("int")
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[ids.select(place.alias("place")).distinct().toArrow().column("place").to_numpy()] = True
    return bits


def _sieve(shared: Broadcast, others: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lets rows (id, place, text) pass whose places are in the shared table; or all the others, and those of a null id."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            among = shared.value[batch.column(1).to_numpy()] & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(among != others))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["id", "text"])

    return passing


def _uncut(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_cut_rows of the others, which lose nothing; in the worker that chooses them, so that no second one runs beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sieve(shared, True)(batches):
            none = list_array(np.zeros(0, np.int64), np.zeros(len(batch), np.int64), pa.int64())
            yield from _cut_rows(iter([pa.RecordBatch.from_arrays([*batch.columns, none, none], names=["id", "text", "repeats", "copied"])]))

    return run


def _placed(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS)).cast("int").alias("place"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_text (the kept words joined by one space) and its kept_sha256 of every row.

    A word goes if a window of 13 consecutive words that covers it also starts in a document of a smaller id; windows are
    judged on the input. Words are split at ASCII white space and compared as they are, by 64-bit hashes of windows. Null
    and empty texts have no words; texts under 13 words lose none; repeats within a document stay; rows of a null id lose
    nothing and take nothing; rows of one id are judged by their own texts; an empty table gives no rows; other columns, even of
    clashing names, do no harm; a text of any length is judged whole, with its words' hashes in memory at once.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_bytes().alias("text"))
    rows = written(texts.mapInArrow(_text_rows, "id long, n long, d1 long, d2 long"), "texts")
    known = texts.where("id is not null")
    owners = rows.where(f"id is not null and n >= {WINDOW}").groupBy("d1", "d2").agg(F.min("id").alias("owner"))
    long = rows.where(f"id is not null and n >= {WINDOW}").select("id", "d1", "d2")
    owned = written(spread_join(long, owners, ["d1", "d2"], "id").select("id", "d1", "owner").distinct(), "owners")

    anchors = known.mapInArrow(_anchor_rows, "deal long, id long, place long, known boolean")
    shared = anchors.repartition("deal").sortWithinPartitions("deal").mapInArrow(_shared_anchors, "id long, place long")
    places = written(shared.groupBy("id").agg(F.collect_set("place").alias("places")), "shared-anchors")  # no more than a text's words
    owner_of = owned.groupBy("id").agg(F.min("owner").alias("owner"))
    seeds = places.join(owner_of, "id")
    pair = "id long, text binary"
    seeded = spark.sparkContext.broadcast(_bits(places.select("id")))
    windows = _placed(known).mapInArrow(_sieve(seeded, False), pair).join(seeds, "id").select("owner", "text", "places").mapInArrow(_window_rows, "deal long, owner long, window long")
    repeats = windows.repartition("deal").sortWithinPartitions("deal", "owner").mapInArrow(_repeats, "owner long, window long")
    dirty = repeats.groupBy(F.col("owner").alias("id")).agg(F.collect_set("window").alias("repeats"))
    whole = owned.where("id > owner").groupBy("id").agg(F.collect_set("d1").alias("copied"))
    marks = written(dirty.join(whole, "id", "full"), "marks")
    for table in (rows, owned, places):
        drop_written(table)
    # only texts that lose words meet their marks; the others stay where they are
    none = F.array().cast("array<bigint>")
    marked = spark.sparkContext.broadcast(_bits(marks.select("id")))
    met = _placed(known).mapInArrow(_sieve(marked, False), pair).join(marks, "id", "left").select("id", "text", F.coalesce("repeats", none).alias("repeats"), F.coalesce("copied", none).alias("copied"))
    kind = "id long, n_words long, n_removed long, kept_text string"
    out = met.mapInArrow(_cut_rows, kind).unionByName(_placed(texts).mapInArrow(_uncut(marked), kind))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).withColumnRenamed("id", id_col)
