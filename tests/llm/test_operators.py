"""Each operator against a plain version, over awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gistmill.llm import bpe, decontamination, fingerprints, jaccard, pii, quality, queries, scoring, sharding, substrings, toxicity, trees
from gistmill.llm.common import Words, grams

from .helpers import SCHEMA, documents, empty, pairs


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return pairs(docs)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_word_hashes_tell_words_apart_across_texts():
    texts = [b"a b  c", b"", b" b", b"c", b"ab", b"A"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    words = Words(raw, np.cumsum([0, *map(len, texts)]).astype(np.int64), lower=True)
    flat = [w for t in texts for w in t.lower().split()]
    assert words.first.tolist() == [0, 3, 3, 4, 5, 6, 7]
    assert len(set(words.hash.tolist())) == len(set(flat))
    assert words.hash[0] == words.hash[6] and words.hash[1] == words.hash[3]
    assert len(grams(words.hash, 8)) == 0


# ---- personal data ------------------------------------------------------------------------------------------------

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark, docs, rows):
    found = sorted((r["doc_id"], r["base_spans"], r["n_card"]) for r in pii.find_personal_data(docs).collect())
    text = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(t))
    assert found == sorted((i, text(t), sum(k == 2 for _, k, _ in plain_spans(t))) for i, t in rows)
    assert pii.find_personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["a@b@c.de.f", "1.2.3.4.5.6.7.8.9", "1.2.3.999 01.02.03.04", "+1 +12345678901 (", "4111-1111 1111--1111", "+49.30.1234567.", "a@b..c x@y.z.", "١٢٣.1.2.3", "é+1234567890é"])
def test_personal_data_edges(text):
    assert [s for s in pii.find(text) if s[1] < 4] == plain_spans(text)


def test_added_kinds_and_redaction():
    text = "IBAN GB82 WEST 1234 5698 7654 32, ssn: 123-45-6789, ftp://bob:pw@host/x"
    assert {pii.KINDS[k] for _, k, _ in pii.find(text)} >= {"account", "ssn", "login"}
    assert pii.redact("to a@b.cd now", pii.find("to a@b.cd now")) == "to <EMAIL> now"
    assert pii.redact(None, []) is None
    assert pii.find("IBAN GB83 WEST 1234 5698 7654 32") == []


# ---- tokens -------------------------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = sorted((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect())
    assert found == sorted((i, coder.encode_ordinary(t or ""), t or "") for i, t in rows)
    assert bpe.encode(empty(spark), path, public_tokenizers.PATTERN, digests=True).count() == 0
    assert len(bpe.read_ranks_of(spark, path)) == len(bpe.read_ranks(path))


@pytest.mark.parametrize("text", ["it's We'LL ½ Ⅳ \x1c\x85  x", "\U0001f600 é́", "  \n  a", "ab" * 700, "²³ ٣ a_b", "a" * 129, " " * 3000, "=-" * 1500, "thequickbrownfoxjumps" * 400, "é" * 500 + "x"])
def test_bpe_edges(text):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.coder(("test",), ranks, public_tokenizers.PATTERN)
    assert own.encode_all([text]) == [tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)]


# ---- near-duplicates and repeats ----------------------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def plain_links(rows):
    """Of each id, the other ids that it links with; of several texts, the most that one has."""
    sets = collections.defaultdict(set)
    for i, t in rows:
        sets[shingles(t)].add(i)
    out = dict.fromkeys((i for i, _ in rows), 0)
    for a, ids in sets.items():
        near = {j for b, others in sets.items() if a and b and 100 * len(a & b) >= 80 * len(a | b) for j in others}
        for i in ids:
            out[i] = max(out[i], len(near - {i}))
    return out


def plain_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in parent}


def test_jaccard_components(spark, docs, rows):
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.link(docs).collect())
    plain, links = plain_components(rows), plain_links(rows)
    assert found == sorted((i, len(shingles(t)), plain[i], links[i]) for i, t in rows)
    assert jaccard.link(docs, links_too=False).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.link(empty(spark)).count() == 0


def test_join_keys_lose_no_pair():
    random = np.random.default_rng(3)
    for _ in range(1500):
        n = int(random.integers(1, 90))
        a = np.unique(random.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(random.integers(0, max(1, len(a) // 8 + 1)))
        b = np.unique(np.append(random.permutation(a)[drop:], random.integers(0, 1 << 63, drop).astype(np.uint64)))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(jaccard.join_keys(a), jaccard.join_keys(b)))
            sketches = [np.frombuffer(jaccard.fine_sketch(x), np.uint8) for x in (a, b)]
            width = min(map(len, sketches))
            differ = (jaccard._folded(sketches[0], width) != jaccard._folded(sketches[1], width)).sum()
            assert differ <= len(a) + len(b) - 2 * shared


def test_large_groups_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_BYTES", 9_000)
    monkeypatch.setattr(jaccard, "STAR", 7)
    random = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(120):  # near copies, and texts that share a passage but are otherwise their own
        words = list(base) if k % 2 else base[:30] + [f"own{k % 7}.{i}" for i in range(30)]
        for _ in range(int(random.integers(0, 3))):
            words[int(random.integers(0, 60))] = f"x{random.integers(0, 50)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(200 + i, texts[i]) for i in range(0, 40, 3)] + [(None, texts[1])]
    found = {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    plain, links = plain_components(rows[:-1]), plain_links(rows[:-1])
    assert found == {(i, plain[i], links[i]) for i in plain} | {(None, None, None)}


def test_chain_of_links_through_middle_texts(spark):
    words = [f"t{i}" for i in range(100)]
    rows = [(10 - k, " ".join(words[k * 4 :] + [f"u{i}" for i in range(k * 4)])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(df).collect()} == plain_components(rows)


def plain_repeats(rows):
    starts = collections.defaultdict(set)
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - 12):
            starts[tuple(words[k : k + 13])].add(i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if min(starts[tuple(words[k : k + 13])]) < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substring_repeats(spark, docs, rows):
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect())
    assert found == plain_repeats(rows)
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_substring_repeats_of_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{i}.{k}' for k in range(i % 9))} {passage if i % 4 else passage[:60]} b{i}") for i in range(300, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect())
    assert found == plain_repeats(rows)


def test_texts_without_repeats(spark):
    passage = [f"p{i}" for i in range(20)]
    texts = {1: ["a", *passage, "b"], 2: ["c", "c2", *passage, "d"], 3: ["a", *passage, "b"], 4: ["e"], 5: ["f", *passage[:13], "g", *passage[5:]]}
    rows = [(i, "  ".join(t) + "\n") for i, t in texts.items()] + [(None, " ".join(texts[1])), (6, None), (4, "h i")]
    found = sorted(((r["doc_id"], r["kept_text"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    plain = [(1, " ".join(texts[1])), (2, "c c2 d"), (3, ""), (4, "e"), (5, "f g"), (None, " ".join(texts[1])), (6, ""), (4, "h i")]
    assert found == sorted(plain, key=str)


# ---- shards and fingerprints --------------------------------------------------------------------------------------


def test_shards(spark, docs, rows):
    plain = docs.toDF("doc_id", "text", *"abcde").select("doc_id", "text")
    assert sharding.shard(docs, shards=3).columns == [*docs.columns, "size", "shard", "slot"]
    found = collected(sharding.shard(plain, shards=4))
    assert len(found) == len(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in found)
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    tasks = sharding.shard(plain, shards=4).groupBy(F.spark_partition_id()).agg(F.countDistinct("shard").alias("n")).collect()
    assert len(tasks) > 1 and {r["n"] for r in tasks} == {1}  # no task sorts two shards
    assert sharding.shard(empty(spark)).count() == 0
    clash = sharding.shard(plain.withColumnRenamed("text", "SIZE"), text_col="SIZE")
    assert "_size" in clash.columns


def test_shards_are_nearly_equal(spark):
    text = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('same ', 20) else repeat(cast(id as string), 1 + cast(id % 17 as int)) end as text")
    sizes = [r["b"] for r in sharding.shard(text, shards=8).groupBy("shard").agg({"size": "sum"}).toDF("shard", "b").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 110 + 0.01 * sum(sizes) / 8


def test_small_groups_of_equal_texts_stay_whole(spark):
    text = spark.range(20_000).selectExpr("id as doc_id", "repeat(cast(id % 4000 as string), 3) as text")
    found = sharding.shard(text, shards=16, tolerance=0.01)
    assert found.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    sizes = [r[1] for r in found.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 16


def test_places_among_boundaries():
    random = np.random.default_rng(8)
    bounds = sorted({(int(a), int(b)) for a, b in random.integers(-4, 4, (20, 2))})
    high, low = random.integers(-5, 5, (2, 500))
    assert sharding.place(bounds, high, low).tolist() == [sum(x <= y for x in bounds) for y in zip(high.tolist(), low.tolist(), strict=True)]
    assert sharding.place([], high, low).tolist() == [0] * 500


def test_digests_are_of_texts_that_shards_hold(spark, monkeypatch):
    shard = sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda docs, **named: shard(docs, **named).withColumn("text", F.concat("text", F.lit(" moved"))))
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r["text_crc32"] for r in queries.op3_histogram_shards(spark, sf).collect()}
    assert found == {i: zlib.crc32(f"{t} moved".encode()) for i, t in texts.items()}


def test_fingerprints(spark, docs, rows):
    found = collected(fingerprints.compare_neighbours(docs, bucket_bytes=20_000))
    ordered = sorted(rows, key=lambda r: r[0])
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in ordered]
    by = {r["doc_id"]: r for r in found}
    for k, (i, t) in enumerate(ordered):
        if sum(i == j for j, _ in ordered) > 1:
            continue
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        tail = len(t) // 4
        edited = t[: len(t) - tail] + after[:tail]
        assert by[i]["n_chars"] == len(t) and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by[i]["near_next"] <= 1 and (by[i]["near_edited"] == 1) == (edited == t)
        if len(t) > 40:
            assert by[i]["near_edited"] > 0.6
    prints = collections.defaultdict(set)
    for i, t in rows:
        prints[t or ""].add(by[i]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len({min(x) for x in prints.values()}) == len(prints)
    assert fingerprints.compare_neighbours(empty(spark)).count() == 0


def test_single_document_is_its_own_neighbour(spark):
    row = fingerprints.compare_neighbours(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert row["near_next"] == 1 and row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_spans_and_common_extensions():
    a, b = "banana band", "a bandana ban"
    x, y = (fingerprints.PrefixHash(fingerprints.codes(t)) for t in (a, b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert fingerprints.common_extension(x, i, y, j) == n


# ---- models -------------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [f"w{(i * 31 + k * k) % 97}" for k in range(20 + i % 50)]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3] = "vermin,"
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, None), (10_000, ""), (10_001, None)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r["score"] for r in module.score(docs, module.fit(docs, labels, label)).collect()}
    assert len(found) == 603 and all(0 <= s <= 1 for s in found.values())
    held = [r for r in labels.collect() if r["doc_id"] is not None and r[label] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((found[r["doc_id"]] >= 0.5) == (r[label] == 1) for r in held) >= 0.95 * len(held)
    nothing = labels.where("doc_id < 0")
    assert module.score(docs, module.fit(docs, nothing, label)).count() == 603
    assert module.score(docs.where("doc_id < 0"), module.fit(docs, labels, label)).count() == 0


def test_tree_arrays_walk_as_trees():
    random = np.random.default_rng(1)
    x = random.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.Trees(rounds=20).fit(x, y)
    total = np.full(len(x), trees.base)
    for f, b, leaf in zip(trees.feature, trees.bound, trees.leaf, strict=True):
        for i, row in enumerate(x):
            at = 0
            for _ in range(trees.depth):
                at = 2 * at + (2 if row[f[at]] > b[at] else 1)
            total[i] += leaf[at - 2**trees.depth + 1]
    assert np.allclose(1 / (1 + np.exp(-total)), trees.score(x)) and ((trees.score(x) > 0.5) == y).mean() > 0.9


def tokens_of(text):
    return [*text.lower().split(), b" "]


def test_base_scores(spark, docs, rows):
    found = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in scoring.score(docs, chunk_bytes=50_000).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens_of((t or "").encode()))
    n, v = sum(count.values()), len(count)
    plain = set()
    for i, t in rows:
        words = tokens_of((t or "").encode())
        plain.add((i, len(words), sum(count[w] > 0 for w in words), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 6)))
    assert {x[:3] for x in found} == {x[:3] for x in plain}
    by = {x[:3]: x[3] for x in found}
    assert all(abs(by[x[:3]] - x[3]) < 1e-4 for x in plain)
    assert scoring.score(empty(spark)).count() == 0


def plain_tree_scores(training, texts):
    """log10 of each text's probability, node by node."""
    depth, end = trees.DEPTH, bytes([trees.END])
    counts, longer = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for text in training:
        whole = end * depth + text.lower() + end
        for i in range(depth, len(whole)):
            for d in range(depth + 1):
                context = whole[i - d : i]
                if d:
                    longer[context[1:]].add(context)
                for k in range(8):
                    counts[context, k, whole[i] >> (8 - k)][whole[i] >> (7 - k) & 1] += 1
    weighted = {}

    def kt(context, k, head):
        zeros, ones = counts.get((context, k, head), (0, 0))
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def log_weighted(context, k, head):
        key = context, k, head
        if key not in counts:
            return 0.0
        if key not in weighted:
            own = kt(*key)
            weighted[key] = own if len(context) == depth else np.logaddexp(own, sum(log_weighted(x, k, head) for x in longer[context])) - math.log(2)
        return weighted[key]

    def one(history, d, k, head):
        key = history[len(history) - d :], k, head
        zeros, ones = counts.get(key, (0, 0))
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == depth or (history[len(history) - d - 1 :], k, head) not in counts:
            return own
        share = math.exp(kt(*key) - math.log(2) - log_weighted(*key))
        return share * own + (1 - share) * one(history, d + 1, k, head)

    out = []
    for text in texts:
        whole, total = end * depth + text.lower() + end, 0.0
        for i in range(depth, len(whole)):
            for k in range(8):
                p = one(whole[i - depth : i], 0, k, whole[i] >> (8 - k))
                total += math.log10(p if whole[i] >> (7 - k) & 1 else 1 - p)
        out.append(total)
    return out


def test_context_tree_against_plain_code(spark):
    random = np.random.default_rng(9)
    vocab = ["abra", "cadabra", "Über", "the", "them", "zz", "\n"]
    rows = [(i, " ".join(random.choice(vocab, int(random.integers(0, 25))))) for i in range(60)] + [(60, None), (61, "ÿÿ unseen"), (7, "repeated id")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(t or "").encode() for _, t in rows]
    plain = plain_tree_scores([t for t, (i, _) in zip(texts, rows, strict=True) if not held(i)], texts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = scoring.score(docs, chunk_bytes=300, bucket_bytes=200).collect()  # many chunks and buckets
    pairs_ = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in found), key=lambda x: (x[0], -x[1], x[2]))
    wanted = sorted(((i, len((t or "").split()) + 1, s) for (i, t), s in zip(rows, plain, strict=True)), key=lambda x: (x[0], -x[1], x[2]))
    assert [x[:2] for x in pairs_] == [x[:2] for x in wanted]
    assert np.allclose([x[2] for x in pairs_], [x[2] for x in wanted], rtol=1e-5, atol=1e-4)
    nothing = scoring.score(docs.where("doc_id = 61"), folds=1).first()  # all held out
    assert nothing["train_tokens"] == 0 and abs(nothing["score"] + 8 * math.log10(2) * (len("ÿÿ unseen".encode()) + 1)) < 1e-3


def test_packed_values_and_lookups():
    random = np.random.default_rng(2)
    keys = np.unique(random.integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (trees.unpack(trees.pack(keys)) == keys).all() and len(trees.unpack(trees.pack(keys[:0]))) == 0
    assert (trees.Lookup(keys, np.arange(len(keys)))(keys[::-1]) == np.arange(len(keys))[::-1]).all()


# ---- leaks --------------------------------------------------------------------------------------------------------


def plain_alignment(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, before[j] + (1 if x == y else -1), before[j + 1] - 1, row[j] - 1))
        best, before = max(best, *row), row
    return best / len(a)


def test_leaks(spark):
    item = [f"q{i}" for i in range(30)]
    edited = [w if i % 7 else "zzz" for i, w in enumerate(item)]
    filler = [f"f{i}" for i in range(300)]
    texts = {1: filler + item + filler, 2: filler[:50] + edited + filler, 3: filler, 4: item[:9] + filler, 5: [w.upper() + "," for w in item]}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(6, None), (7, ""), (1, " ".join(texts[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "q1 q2"), (3, "other words not there at all")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in decontamination.find_leaks(docs, bench).collect())
    plain = {i: round(plain_alignment(item, [w.lower().strip(",") for w in t]), 6) for i, t in texts.items()}
    assert found == sorted((i, 0, plain[i]) for i in (1, 1, 2, 5)) and plain[4] < 0.5
    assert decontamination.find_leaks(docs, bench.where("item_id < 0")).count() == 0
    assert decontamination.find_leaks(docs.where("doc_id < 0"), bench).count() == 0


def test_leaks_of_short_runs(spark):
    random = np.random.default_rng(5)
    items = {0: [f"a{i}" for i in range(20)], 1: [f"b{i}" for i in range(30)], 2: [f"c{i}" for i in range(5)], 3: [f"d{i}" for i in range(24)], 4: ["e0", "e1", "e2"]}
    filler = [f"f{i}" for i in range(40)]
    edits = [
        [w if i % 5 < 4 else "zzz" for i, w in enumerate(items[0])],
        [w if i % 4 < 3 else "zzz" for i, w in enumerate(items[1])],
        *([w if i != j else "zzz" for i, w in enumerate(items[2])] for j in range(5)),
        [x for i, w in enumerate(items[3]) for x in ([w, "zzz"] if i % 2 and i < 23 else [w])],  # a word put in after every second
        ["e0", "e1", "zzz"],
    ]
    edits += [edits[0], items[0], edits[1]] * 3  # equal copies, edited and not
    for _ in range(60):
        item = items[int(random.integers(0, 5))]
        edits.append([x for w in item for x in ([], ["yyy"], [w, "yyy"], [w], [w], [w], [w], [w])[int(random.integers(0, 8))]])
    rows = [(k, " ".join(filler[: k % 40] + x + filler)) for k, x in enumerate(edits)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in decontamination.find_leaks(docs, bench).collect()}
    plain = {(i, k): round(plain_alignment(x, t.split()), 6) for i, t in rows for k, x in items.items()}
    assert found == {pair: s for pair, s in plain.items() if s >= decontamination.LEAST_SCORE}
    assert {(k, x) for k, x in enumerate((0, 1, 2, 2, 2, 2, 2, 3))} <= set(found)


def test_no_rows_for_an_empty_schema(spark):
    assert spark.createDataFrame([], SCHEMA).count() == 0


def test_clashing_names_and_long_texts(spark, docs, rows):
    """Every operator over the awkward rows, one text of which has some 30,000 words, with clashing columns beside."""
    labels = spark.createDataFrame([(i, int(k % 3 > 0), int(k % 4 == 0), "clash") for k, (i, _) in enumerate(rows)] + [(None, None, None, None)], "doc_id long, quality int, toxic int, Quality string")
    ids = sorted(i for i, _ in rows)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        plain = labels.toDF("doc_id", "quality", "toxic", "other")
        found = module.score(docs, module.fit(docs, plain, label)).collect()
        assert sorted(r["doc_id"] for r in found) == ids and all(0 <= r["score"] <= 1 for r in found)
    item = next(t for _, t in rows if t and len(t) > 100_000).split()[20_000:20_040]
    bench = spark.createDataFrame([(1, " ".join(item), None, "x"), (None, None, None, None)], "item_id long, text string, Text string, doc_id string")
    bench = bench.toDF("item_id", "text", "other", "doc_id")
    assert {(r["item_id"], r["score"]) for r in decontamination.find_leaks(docs, bench).collect()} >= {(1, 1.0)}


# ---- plain versions of what has no SQL ------------------------------------------------------------------------------


def test_learning_against_plain_code():
    """FTRL coordinate by coordinate, with dictionaries."""
    random = np.random.default_rng(4)
    examples = [(np.unique(random.integers(0, 40, int(random.integers(1, 12)))).astype(np.int32), int(random.random() < 0.4)) for _ in range(300)]
    rate, beta, l1, l2, heavier = 1.0, 1.0, 8.0, 0.1, 2.0
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / rate)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / rate + l2)

    for _ in range(3):
        for at, y in examples:
            active = [*at.tolist(), "bias"]
            w = {i: weight(i) for i in active}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (heavier if y else 1)
            for i in active:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rate * w[i]
                n[i] += g * g
    at, weights, bias = toxicity.train(examples)
    plain = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(at.tolist(), np.round(weights, 9).tolist(), strict=True)) == {i: round(x, 9) for i, x in plain.items()} and plain
    assert abs(bias - weight("bias")) < 1e-9


def test_features_against_plain_code():
    """Equal features share a coordinate, across texts and cases; a text's are its distinct words, pairs and skip-pairs."""
    texts = ["Alpha beta, alpha GAMMA", "beta alpha", "", "gamma delta alpha beta", "über b über"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)]).astype(np.int64)
    at, bounds = toxicity.distinct(*toxicity.occurrences(raw, offsets), len(texts))
    named = {}
    for k, text in enumerate(texts):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
        own = {*w, *zip(w, w[1:], strict=False), *((a, "_", b) for a, b in zip(w, w[2:], strict=False))}
        assert bounds[k + 1] - bounds[k] == len(own)
        for x in own:
            named.setdefault(x, []).append(set(at[bounds[k] : bounds[k + 1]].tolist()))
    assert all(set.intersection(*sets) for sets in named.values())


def test_statistics_against_plain_code(rows):
    texts = [(t or "").encode() for _, t in rows]
    x = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]).astype(np.int64))
    at = {name: k for k, name in enumerate(quality.STATISTICS)}
    for text, row in zip(texts, x, strict=True):
        words, lines = text.split(), text.split(b"\n") if text else []
        length = [len(w) for w in words] or [0]
        share = lambda chars: sum(c in chars for c in text) / max(len(text), 1)  # noqa: E731, B023
        plain = {
            "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "share_upper": share(range(65, 91)), "share_digit": share(range(48, 58)),
            "share_stop": share(b".?"), "share_lead": share(range(192, 256)), "share_blank": share(b" "), "word_mean": np.mean(length), "word_deviation": np.std(length), "word_longest": max(length),
            "short_words": sum(n <= 3 for n in length if words) / max(len(words), 1), "distinct_words": len({w.lower() for w in words}) / max(len(words), 1),
            "distinct_lines": len(set(lines)) / max(len(lines), 1), "line_words": len(words) / max(len(lines), 1), "upper_starts": sum(65 <= w[0] <= 90 for w in words) / max(len(words), 1),
        }
        assert np.allclose([row[at[k]] for k in plain], list(plain.values()), atol=1e-6), (text[:50], plain)


def test_first_tree_against_plain_code():
    """The first split of the first tree is the best of every cut of every column."""
    random = np.random.default_rng(6)
    x = random.normal(size=(400, 4))
    y = (x[:, 2] + 0.3 * random.normal(size=400) > 0.4).astype(float)
    found = quality.Trees(depth=1, rounds=1).fit(x, y)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (0, 0, 0)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= cut
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, j, cut))
    left = x[:, best[1]] <= best[2]
    assert (found.feature[0, 0], found.bound[0, 0]) == best[1:]
    assert np.allclose(found.leaf[0], [-0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_placement_against_plain_code(spark):
    """Shards are runs of the order by (hash of text, id), whose ends lie as near to equal bytes as whole rows allow."""
    text = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 1 + cast(id % 23 as int)) as text")
    found = sharding.shard(text, shards=7).withColumn("high", F.xxhash64(F.encode("text", "utf-8"))).orderBy("high", "doc_id").collect()
    total, below, ends = sum(r["size"] for r in found), 0, []
    for r, after in zip(found, [*found[1:], None], strict=True):
        below += r["size"]
        if after is None or after["shard"] != r["shard"]:
            ends.append((r["shard"], below))
    assert [s for s, _ in ends] == list(range(7))
    most = max(r["size"] for r in found)
    assert all(abs(end - total * (s + 1) / 7) <= total / 7 * 0.002 + most for s, end in ends)
    number = collections.Counter()
    for r in found:
        assert r["slot"] == number[r["shard"]]
        number[r["shard"]] += 1


def test_few_buckets_hold_the_same_rows(spark, monkeypatch):
    """Where boundaries reach the driver's bound, parts and buckets grow; rows stay the same."""
    text = spark.range(2000).selectExpr("id as doc_id", "repeat(cast(id as string), 1 + cast(id % 23 as int)) as text")
    many = sorted(map(tuple, sharding.shard(text, shards=3, part_bytes=1000).select("doc_id", "shard", "slot").collect()))
    prints = sorted(map(tuple, fingerprints.compare_neighbours(text, bucket_bytes=1000).collect()))
    monkeypatch.setattr(sharding, "MOST_BUCKETS", 6)
    few = sorted(map(tuple, sharding.shard(text, shards=3, part_bytes=1000).select("doc_id", "shard", "slot").collect()))
    assert len(few) == len(many) == 2000 and sum(a == b for a, b in zip(few, many, strict=True)) > 1900
    assert sorted(map(tuple, fingerprints.compare_neighbours(text, bucket_bytes=1000).collect())) == prints


def test_likeness_against_plain_code():
    random = np.random.default_rng(3)
    for _ in range(200):
        a = "".join(random.choice(list("abcdé"), int(random.integers(0, 300))))
        cut = sorted(random.integers(0, len(a) + 1, 2).tolist())
        b = a[: cut[0]] + "".join(random.choice(list("xyz"), int(random.integers(0, 30)))) + a[cut[1] :]
        head = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        tail = next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
        on_grid = lambda n: max((int(g) for g in fingerprints.GRID if g <= n), default=0)
        plain = 1.0 if a == b else min(min(on_grid(head) + on_grid(tail), len(a), len(b)) / max(len(a), len(b)), 1 - 1e-9)
        x, y = (fingerprints.Fingerprint(fingerprints.PrefixHash(fingerprints.codes(t))) for t in (a, b))
        assert abs(fingerprints.likeness(x, y) - plain) < 1e-12, (a, b)


# ---- the registered queries, over the whole of the smallest tables ----------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_of_personal_data(spark, whole):
    found = {r["doc_id"]: r for r in queries.op1_pii_anchors(spark, SF).collect()}
    assert len(found) == len(whole)
    for i, t in whole:
        spans = plain_spans(t)
        assert [found[i][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert found[i]["base_sha256"] == digest(",".join(base)) and set(base) <= set(found[i]["spans"].split(",")) | {""}


def test_query_of_shards(spark, whole):
    found = {r["doc_id"]: r for r in queries.op3_histogram_shards(spark, SF).collect()}
    assert set(found) == {i for i, _ in whole}
    for i, t in whole:
        assert (found[i]["size"], found[i]["text_crc32"], found[i]["law"], found[i]["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
    slots = collections.defaultdict(list)
    for r in found.values():
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_query_of_fingerprints(spark, whole):
    found = {r["doc_id"]: r for r in queries.op4_prefix_fingerprints(spark, SF).collect()}
    assert set(found) == {i for i, _ in whole}
    own = lambda t: fingerprints.Fingerprint(fingerprints.PrefixHash(fingerprints.codes(t)))
    for k, (i, t) in enumerate(whole):
        after, tail = whole[(k + 1) % len(whole)][1], len(t) // 4
        edited = t[: len(t) - tail] + after[:tail]
        a, b, c = own(t), own(edited), own(after)
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), digest(edited), str(a), str(b))
        assert abs(r["near_edited"] - fingerprints.likeness(a, b)) < 1e-12 and abs(r["near_next"] - fingerprints.likeness(a, c)) < 1e-12


def test_query_of_tokens(spark, whole):
    coder = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.read_ranks(queries.VOCABULARY), special_tokens={})
    found = sorted(map(tuple, queries.op5_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    ids = [(i, coder.encode_ordinary(t), t) for i, t in whole]
    assert found == [(i, len(x), digest(" ".join(map(str, x))), digest(t)) for i, x, t in ids]


def test_query_of_base_scores(spark, whole):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter(w for i, t in whole if not held(i) for w in tokens_of(t.encode()))
    n, v = sum(count.values()), len(count)
    found = {r["doc_id"]: r for r in queries.op7_context_tree(spark, SF).collect()}
    assert set(found) == {i for i, _ in whole}
    for i, t in whole:
        words, r = tokens_of(t.encode()), found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(words), sum(count[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-4 and r["score"] < 0


def test_query_of_leaks(spark, whole):
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [(r["item_id"], split(r["text"] or "")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in queries.op8_decontamination(spark, SF).collect()}
    plain = {}
    for i, t in whole:
        words = split(t)
        held = collections.Counter(words)
        for k, item in items:
            # too few common words bound the score, so the alignment may be left out
            if len(item) >= 3 and sum((collections.Counter(item) & held).values()) >= decontamination.LEAST_SCORE * len(item):
                score = plain_alignment(item, words)
                if score >= decontamination.LEAST_SCORE:
                    plain[i, k] = round(score, 6)
    assert found == plain and plain


@pytest.mark.parametrize("name,least", [("op6_toxicity_ftrl", 0.5), ("op10_quality_trees", 0.3)])
def test_queries_of_classifiers(spark, whole, name, least):
    found = {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}
    assert set(found) == {i for i, _ in whole}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
