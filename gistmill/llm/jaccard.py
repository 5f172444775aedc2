"""N-gram Jaccard join by parity sketches, and the components of its links.

A document's set is that of its distinct word 5-grams. Two sets of x <= y elements with a Jaccard similarity of 0.8 or more
differ in (x + y) / 9 elements at most, and y <= 1.25 x. In each size band with at most k differing elements, elements are
dealt by hash into m > k blocks, and each block keeps the XOR of its elements' hashes: a parity sketch. A differing element
changes one block, so m - k blocks or more agree (pigeonhole). Blocks are ordered by size and hash; a set with k + 1 or more
non-empty blocks joins by its first k + 1, since the agreeing non-empty blocks are too many to lie behind those; a set with
fewer (small ones) joins by all of them and by the shingles that come first in hash order as well. So no link is lost.

Equal sets are first gathered under their smallest id. Sets that share a block are compared with the block's smallest id;
only where a block still holds several components are the others compared, and there a finer parity sketch, whose differing
blocks are a lower bound of the differing elements, decides which pairs are verified. Links are verified on whole sets. As all
links lie within components, their number is then counted there, over tiles of sets of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, drop_written, grams, list_array, pick, returning, ship, splitmix, spread_join, text_bytes, tiled, written
from .graph import components

#: Words of a shingle.
SHINGLE = 5
#: Least sizes of the bands, each half as large again as the one before.
BANDS = [1, 2, 3, 4]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] + max(1, BANDS[-1] // 2))
_BANDS = np.array(BANDS)
#: Bits of the table by which most texts are left out before their sets are made again.
_FILTER_BITS = 22
#: Pairs of one set that one task verifies; bytes of a tile of sets or sketches, and of all sets to a bucket.
STAR, TILE_BYTES, SETS_BYTES = 512, 4 << 20, 64 << 20


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one hash of all its words where these are fewer than a shingle's."""
    words = Words(raw, offsets, lower=True)
    found = grams(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            x = np.sort(found[a : b - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            out.append(splitmix(grams(words.hash[a:b], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_limits(band: int) -> tuple[int, int, int]:
    """Of a band: the largest size that takes part, the most differing elements k, and the number of blocks."""
    top = BANDS[band + 1] - 1
    largest = top * 5 // 4
    k = (top + largest) // 9
    return largest, k, k + 1 + max(1, (k + 1) // 2)


def join_keys(elements: np.ndarray) -> np.ndarray:
    """The keys by which a set joins: at least one is shared by every two sets that link."""
    n = len(elements)
    keys = []
    band = int(np.searchsorted(_BANDS, n, "right")) - 1
    mixed = splitmix(elements)
    while band >= 0:
        largest, k, m = band_limits(band)
        if largest < n:
            break
        block = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the elements are
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(start, n))
        parity = np.bitwise_xor.reduceat(mixed, start)
        key = splitmix(parity ^ splitmix(block[start] * np.uint64(1 << 20) + np.uint64(band)) ^ (size.astype(np.uint64) << np.uint64(40)))
        if len(start) > k + 1:
            key = key[np.lexsort((key, -size))[: k + 1]]
        elif len(start) < k + 1:
            keys.append(splitmix(elements[: n - (4 * n + 4) // 5 + 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        keys.append(key)
        band -= 1
    return np.unique(np.concatenate(keys))


def fine_sketch(elements: np.ndarray) -> bytes:
    """A parity byte for each of 2**floor(log2(n)) blocks; folding neighbours together gives the sketch of half as many."""
    n = len(elements)
    bits = max(n, 1).bit_length() - 1
    out = np.zeros(1 << bits, np.uint8)
    if n:
        block = (elements >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[block[start]] = (np.bitwise_xor.reduceat(splitmix(elements), start) & np.uint64(0xFF)).astype(np.uint8)
    return out.tobytes()


def _folded(sketch: np.ndarray, blocks_: int) -> np.ndarray:
    while sketch.shape[-1] > blocks_:
        sketch = sketch[..., ::2] ^ sketch[..., 1::2]
    return sketch


@returning
def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in blocks(batch, "text"):
            sets = shingle_sets(raw, offsets)
            digests = np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["id", "n", "d1", "d2"])


@returning
def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each set; of equal sets in a task the first is enough, since equal sets are linked by their digests."""
    seen: set[bytes] = set()
    for batch in batches:
        for a, b, raw, offsets in blocks(batch, "text"):
            keys, counts = [np.zeros(0, np.uint64)], []
            for x in shingle_sets(raw, offsets):
                own = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                if not len(x) or own in seen:
                    counts.append(0)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(own)
                keys.append(join_keys(x))
                counts.append(len(keys[-1]))
            ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), counts)
            keys = np.concatenate(keys).view(np.int64)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(ids[at : at + 100_000], pa.int64())], names=["key", "id"])


@returning
def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has; one row is held between batches."""
    key, own, given = None, None, False
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        if key is not None:
            keys, ids = np.append(key, keys), np.append(own, ids)
        same = keys[1:] == keys[:-1]
        emit = np.append(False, same) | np.append(same, False)
        if key is not None and given:
            emit[0] = False
        key, own, given = keys[-1], ids[-1], bool(emit[-1]) or (len(keys) == 1 and given)
        yield pa.RecordBatch.from_arrays([pa.array(keys[emit]), pa.array(ids[emit])], names=["key", "id"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first columns are equal."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


@returning
def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, tile, id, label, n, sketch) sorted by the first three: pairs whose labels differ and whose sizes and sketches allow a link."""
    out: list[tuple[int, int]] = []

    def compare(held: list[tuple]) -> Iterator[None]:
        if len({x[5] for x in held}) < 2:
            return
        own = sorted(held, key=lambda x: (x[6], x[4]))  # by size
        tiles, ids, labels, sizes = (np.array([x[i] for x in own]) for i in (3, 4, 5, 6))
        across = held[0][1] != held[0][2]
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.array([len(x[7]) for x in own])
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            by_width[int(w)] = rows, np.stack([np.frombuffer(own[i][7], np.uint8) for i in rows])
        for i, row in enumerate(own):
            mine = np.frombuffer(row[7], np.uint8)
            for w, (rows, sketches) in by_width.items():
                fits = (rows > i) & (sizes[rows] * 4 <= row[6] * 5) & (labels[rows] != row[5])
                if across:
                    fits &= tiles[rows] != row[3]
                if not fits.any():
                    continue
                other, most = rows[fits], (sizes[rows[fits]] + row[6]) // 9
                width = min(w, len(mine))
                differ = (_folded(sketches[fits], width) != _folded(mine, width)).sum(1)
                out.extend((min(row[4], int(ids[j])), max(row[4], int(ids[j]))) for j in other[differ <= most])
            if len(out) > 50_000:
                yield

    def give() -> pa.RecordBatch:
        pairs = np.array(out, np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for held in _groups(batches, 3):
        for _ in compare(held):
            yield give()
    yield give()


def count_links(sets: list[np.ndarray], weights: np.ndarray, tiles: np.ndarray | None = None) -> np.ndarray:
    """For each set, the sum of the weights of those it links with; with tiles, only of sets of another tile."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    size, weight, tile = sizes[order], weights[order], None if tiles is None else tiles[order]
    _, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    start, last = np.append(0, np.cumsum(size)), np.searchsorted(size, size * 5 // 4, "right")
    mine, out = np.zeros(int(flat.max(initial=0)) + 1, bool), np.zeros(len(sets), np.int64)
    for i in range(len(sets)):
        a, b = i + 1, int(last[i])
        if a >= b or (tile is not None and (tile[a:b] == tile[i]).all()):
            continue
        own = flat[start[i] : start[i + 1]]
        mine[own] = True
        shared = np.add.reduceat(mine[flat[start[a] : start[b]]], start[a:b] - start[a], dtype=np.int64)
        mine[own] = False
        linked = 100 * shared >= 80 * (size[i] + size[a:b] - shared)
        if tile is not None:
            linked &= tile[a:b] != tile[i]
        out[order[i]] += weight[a:b][linked].sum()
        out[order[a:b][linked]] += weight[i]
    return out


@returning
def _link_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (label, i, j, tile, id, copies, elements) sorted by the first three: (id, links) with sets met here."""
    ids, links = [], []
    for held in _groups(batches, 3):
        across = held[0][1] != held[0][2]
        sets = [np.array(x[6], np.int64).view(np.uint64) for x in held]
        ids += [x[4] for x in held]
        links.append(count_links(sets, np.array([x[5] for x in held], np.int64), np.array([x[3] for x in held]) if across else None))
        if len(ids) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(links))], names=["id", "links"])
            ids, links = [], []
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *links]))], names=["id", "links"])


def _member_sets(bits):
    """Sets and fine sketches of the texts whose ids may be wanted."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(1).to_numpy()]))
            for a, b, raw, offsets in blocks(batch, "text"):
                sets = shingle_sets(raw, offsets)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), list_array(flat, np.array([len(x) for x in sets]), pa.int64()), pa.array([fine_sketch(x) for x in sets], pa.binary())],
                    names=["id", "n", "elements", "sketch"],
                )

    return run


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as a table, with the number of parts into which those of one `a` are dealt; it is 1 but for very many."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")).where("parts > 1")
    return written(spread_join(pairs, many, ["a"], "b", "left").select("a", "b", F.coalesce("parts", F.lit(1)).alias("parts")), "pairs")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of dealt pairs whose sets link: 100 * intersection >= 80 * union. sets is bucketed by id and stays where it is."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    few = pairs.where("parts = 1").join(left, "a").select("a", "b", "na", "ea")
    many = pairs.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    spread = left.join(many.select("a", "parts").distinct(), "a").select("a", "na", "ea", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = few.unionByName(many.join(spread, ["a", "part"]).select("a", "b", "na", "ea"))
    met = both.join(right, "b").withColumn("shared", F.size(F.array_intersect("ea", "eb")).cast("long"))
    return met.where("100 * shared >= 80 * (na + nb - shared)").select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links_too: bool = True) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links, itself included) and n_links of every row.

    Words are split at ASCII white space and A-Z lower-cased. Null and empty texts have no shingles and link with nothing;
    of a text of fewer than five words all words are its one shingle. Rows of one id are one document of the component;
    rows of a null id link with nothing and have a null component; an empty table gives none; other columns, even of clashing
    names, do no harm; a text of any length is one set, in memory at once. Shingles are compared by 64-bit hashes of their words.

    n_links is the number of other documents that a row's document links with, copies included (of an id with several texts,
    that of the text with the most); null for a null id. It is counted from all pairs of distinct sets of a component, tile by
    tile, and no pair is written. Without links_too that column and its work are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), text_bytes().alias("text"))
    rows = written(texts.mapInArrow(_set_rows, "id long, n long, d1 long, d2 long"), "sets")
    filled = rows.where("n > 0 and id is not null")
    equal = filled.groupBy("d1", "d2").agg(F.min("id").alias("first"))
    # equal sets under their smallest id
    named = written(spread_join(filled.select("id", "d1", "d2"), equal, ["d1", "d2"], "id").select("id", "first").distinct(), "named")
    least = named.groupBy("id").agg(F.min("first").alias("least"))

    keyed = texts.where("id is not null").mapInArrow(_key_rows, "key long, id long")
    shared = written(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_shared_rows, "key long, id long"), "shared-keys")
    members = shared.join(least, "id").select("key", F.col("least").alias("id")).distinct()
    pivots = members.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    members = written(members.join(pivots, "key"), "members")
    drop_written(shared)

    place = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS)).cast("int")
    taken = members.select(place.alias("place")).distinct().toArrow().column("place").to_numpy()  # a bounded table
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[taken] = True
    near = texts.where("id is not null").select("id", place.alias("place"), "text")
    wanted = members.select("id").distinct()
    buckets = max(32, (rows.agg(F.sum("n")).first()[0] or 0) * 8 // SETS_BYTES)
    found = near.mapInArrow(_member_sets(spark.sparkContext.broadcast(bits)), "id long, n long, elements array<bigint>, sketch binary")
    sets = written(found.repartition(buckets, "id").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "member_sets", buckets, "id")

    stars = _dealt(members.where("id > pivot").groupBy("id").agg(F.min("pivot").alias("pivot")).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    links = written(_verified(stars, sets), "star-links")
    labels = components(links)
    # blocks that hold several components still
    labelled = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    of_key = [F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")]
    several = labelled.groupBy("key").agg(*of_key).where("least < most").groupBy("rows", "h1", "h2").agg(F.min("key").alias("key")).select("key")  # of blocks with the same sets one is enough
    asked = labelled.join(several, "key").join(sets.select("id", "n"), "id")
    asked = tiled(asked, "key", "id", F.col("n") + 64, TILE_BYTES)  # sets and sketches come last, as they are large
    asked = asked.join(sets.select("id", "sketch"), "id").select("key", "i", "j", "tile", "id", "label", "n", "sketch")
    crossing = asked.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross_pairs, "a long, b long").distinct()
    crossing = written(crossing.join(stars, ["a", "b"], "left_anti"), "crossing")
    crossed = _dealt(crossing)
    more = written(_verified(crossed, sets), "cross-links")
    for table in (members, stars, crossing, crossed):
        drop_written(table)

    several_sets = named.join(least, "id").where("first <> least").select(F.col("least").alias("a"), F.col("first").alias("b"))  # of one id
    found = components(links.unionByName(more).unionByName(several_sets))  # copies stay out: they take their first one's label
    counted = [F.min(F.coalesce("label", "first")).alias("label")]
    if links_too:
        copies = named.groupBy(F.col("first").alias("id")).agg(F.count(F.lit(1)).alias("copies"))
        grouped = sets.select("id", "n").join(found.withColumnRenamed("node", "id"), "id").join(copies, "id")
        grouped = tiled(grouped, "label", "id", F.col("n") * 8 + 64, TILE_BYTES)
        grouped = grouped.join(sets.select("id", "elements"), "id").select("label", "i", "j", "tile", "id", "copies", "elements")
        met = grouped.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_link_counts, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
        counts = copies.join(met, "id", "left").select(F.col("id").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        found = counts.join(found.withColumnRenamed("node", "first"), "first", "left")
        counted.append(F.max("n_links").alias("n_links"))
    else:
        found = found.withColumnRenamed("node", "first")
    found = written(spread_join(named, found, ["first"], "id", "left").groupBy("id").agg(*counted), "found")
    for table in (named, sets, links, more):
        drop_written(table)
    out = rows.join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"), *(["n_links"] if links_too else []))
    return out.withColumn("n_links", F.when(F.col(id_col).isNotNull(), F.coalesce("n_links", F.lit(0)))) if links_too else out
