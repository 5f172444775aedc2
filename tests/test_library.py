"""Hand-computed answers and plain versions for the digest operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.functions import text as T
from gistmill.functions.stem import porter
from gistmill.operators import lexrank, masking, ordering, realization, rouge, selection, similarity, tables, tfidf, vectors
from gistmill.sources import files, newswire

MICRO = [(1, "Dogs chase cats and cats ."), (2, "Cats chase dogs ."), (3, "Cats eat mice .")]


@pytest.fixture(scope="module")
def micro(spark):
    rows = spark.createDataFrame([("A", i, "en", t) for i, t in MICRO], "docset_id string, doc_id long, lang string, text string")
    return tables.sentences(rows)


@pytest.fixture(scope="module")
def terms(micro):
    return tables.terms(micro)


def test_counts_and_idf(terms):
    counted = tfidf.tf(terms, "document")
    expected = {"documented": (1.267984, 0.805361, 0.490279), "ratio": (2.008333, 1.488457, 1.230628), "collection": (1.267984, 0.805361, 0.251050), "constant": (1.230628,) * 3}
    for formula, (rare, middle, common) in expected.items():
        found = {r["term"]: (r["df"], r["cf"], r["idf"]) for r in tfidf.idf(counted, "document", formula).collect()}
        assert {k: v[:2] for k, v in found.items()} == {"and": (1, 1), "eat": (1, 1), "mice": (1, 1), "dogs": (2, 2), "chase": (2, 2), "cats": (3, 4)}
        assert [round(found[t][2], 6) for t in ("mice", "dogs", "cats")] == [rare, middle, common]
    assert round(tfidf.unseen_weight(), 6) == -1.581070 or math.isclose(tfidf.unseen_weight(), math.log(0.01) * (math.log(0.7) + 0.7))
    with pytest.raises(ValueError):
        tfidf.check(4, "docset")
    with pytest.raises(ValueError):
        tfidf.idf(counted, "document", "other")


def test_similarity_and_lexrank(spark, micro, terms):
    raw = tfidf.tf(terms, "sentence").withColumn("w", F.col("tf").cast("double"))
    edges = similarity.cosine_edges(raw)
    found = {(r["i"]["doc_id"], r["j"]["doc_id"]): round(r["w"], 6) for r in edges.collect()}
    assert found == {(1, 2): 0.872872, (2, 1): 0.872872, (1, 3): 0.436436, (3, 1): 0.436436, (2, 3): 0.333333, (3, 2): 0.333333}
    nodes = micro.select("docset_id", F.struct("doc_id", "sent_idx").alias("i"))
    for mode, ten, end in (("documented", (1, 0.926435, 0.628798), (1, 0.925708, 0.628489)), ("as_implemented", (1, 0.969505, 0.749752), (1, 0.969401, 0.749704))):
        scores = {r["i"]["doc_id"]: r["score"] for r in lexrank.fixed_iterations(nodes, edges, 10, mode=mode).collect()}
        done = {r["doc_id"]: r["score"] for r in lexrank.converged(raw, micro, lexrank.Config(threshold=0, mode=mode)).collect()}
        print(mode, scores, done)
        assert [round(scores[i], 3) for i in (1, 2, 3)] == [round(x, 3) for x in ten]
        assert [round(done[i], 3) for i in (1, 2, 3)] == [round(x, 3) for x in end]
    assert [r["rank"] for r in lexrank.ranked(lexrank.converged(raw, micro)).orderBy("rank").collect()] == [0, 1, 2]
    assert similarity.degrees(edges).count() == 3
    total = similarity.column_normalized(edges).groupBy("j").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in total)


def test_jaccard_and_rouge(spark, micro):
    d = spark.createDataFrame([(["dogs", "chase", "cats", "and", "cats"], ["cats", "chase", "dogs"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(T.jaccard_distance(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0]
    one, two = (micro.where(f"doc_id = {i}").select("docset_id", "doc_id", "tokens") for i in (1, 2))
    r = rouge.scores(one, two.withColumnRenamed("doc_id", "ref"), ["docset_id"], ["doc_id"], ["ref"]).first()
    assert [round(r[x], 6) for x in "prf"] == [0.6, 1.0, 0.75]
    assert rouge.scores(one, two.withColumnRenamed("doc_id", "ref"), ["docset_id"], ["doc_id"], ["ref"], 2).first()["f"] == 0
    assert rouge.scores(one, one.withColumnRenamed("doc_id", "ref"), ["docset_id"], ["doc_id"], ["ref"]).first()["f"] == 1
    table = spark.createDataFrame([("1", "rouge-1", "D1001-A.M.100.A.1", 0.10465, 0.07407, 0.08674)], "method string, rouge string, file string, p double, r double, f double")
    lines = {r["line"] for r in rouge.report_lines(table).collect()}
    assert "1 ROUGE-1 Eval D1001-A.M.100.A.1 R:0.07407 P:0.10465 F:0.08674" in lines and "1 ROUGE-1 Average_R 0.07407" in lines
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "base_id string")
    assert rouge.same_ids(ids("a", "b"), ids("b", "a")) == 0 and rouge.same_ids(ids("a"), ids("b")) == 2


def test_stems_and_limits(spark, micro):
    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
        conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
        relational relat conditional condit rational ration valenci valenc digitizer digit vietnamization vietnam predication predic operator oper feudalism feudal
        decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
        electriciti electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt
        homologou homolog communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()
    assert [porter(x) for x in pairs[::2]] == pairs[1::2]
    assert [porter(x) for x in ("is", "don't", "naïve", "x1s")] == ["is", "don't", "naïve", "x1s"]
    kind = "docset_id string, i int, tokens array<string>"
    a, b = spark.createDataFrame([("A", 1, ["Dogs", "chased", "cats"]), ("A", 2, []), ("A", 3, None)], kind), spark.createDataFrame([("A", 1, ["dog", "chasing", "birds"])], kind).withColumnRenamed("i", "j")
    found = lambda **how: {r["i"]: round(r["f"], 6) for r in rouge.scores(a, b, ["docset_id"], ["i"], ["j"], **how).collect()}
    assert found() == {1: 0, 2: 0, 3: 0} and found(stem=True) == {1: 0.666667, 2: 0, 3: 0} and found(stem=True, n=2)[1] == 0.5
    assert found(stem=True, limit=2)[1] == 1 and found(stem=True, limit=1)[1] == 1


def test_text_functions(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert one("WASHINGTON (AP) _ Gov. Smith  spoke (212) 555-0100 .", T.clean_paragraph) == " Governor Smith spoke  ."
    assert one("COPYRIGHT 1998 BY WORLDSOURCES x", T.is_dropped) and one("  ", T.is_dropped) and not one("x", T.is_dropped)
    assert one("It is 3.14 now. Yes!  No? end", T.sentences) == ["It is 3.14 now.", "Yes!", "No?", "end"]
    assert one("Don't, ünder_1 &amp;", T.tokens) == ["Don", "'", "t", ",", "ünder_1", "&", "amp", ";"]
    toks = F.array(*map(F.lit, ["The", "&", "dog", "."]))
    assert one("", lambda _: T.words(toks)) == ["the", "&", "dog"] and one("", lambda _: T.words(toks, entities=False)) == ["the", "dog"]
    assert one("", lambda _: T.drop_stopwords(T.words(toks, entities=False))) == ["dog"]
    abc = F.array(*map(F.lit, "abc"))
    assert one("", lambda _: T.ngrams(abc, 3)) == ["<s> <s> a", "<s> a b", "a b c", "b c </s>", "c </s> </s>"]
    assert one("", lambda _: T.ngrams(abc, 2, padded=False)) == ["a b", "b c"] and one("", lambda _: T.ngrams(abc, 4, padded=False)) == []
    for name, date in (("APW19980602.1383", "19980602"), ("APW_ENG_20041007.0256", "20041007"), ("AFP_ENG_20061002.0523", "20061002")):
        assert one(name, T.date_of) == date
    assert one("D1001A-A", lambda c: T.summary_file_name(c, F.lit("2"))) == "D1001-A.M.100.A.2"
    assert one("", lambda _: T.detokenize(F.array(*map(F.lit, ["He", "said", "(", "well", ")", ",", "it", "'", "s", "fine", "."])))) == "He said (well), it's fine."
    assert one("a foo] [bar  b", T.clean_generation) == "a b" and one("abcdef", lambda c: T.replace_span(c, "X", 1, 3)) == "aXdef"
    assert one(None, T.headline) == "NONE" and one(" a\nb ", T.headline) == "a b"
    assert T.detokenizer(False)(abc) is abc and T.detokenizer(True) is T.detokenize


def test_lead_and_greedy(spark):
    rows = [("D", 1, k, ["w"] * n) for k, n in enumerate((120, 60, 30, 20, 5))] + [("D", 2, 0, ["x"] * 10)]
    sents = spark.createDataFrame(rows, "docset_id string, doc_id long, sent_idx int, tokens array<string>")
    assert [(r["sent_idx"], r["running"]) for r in selection.lead_k(sents).orderBy("sent_idx").collect()] == [(1, 60), (2, 90)]
    ranked = [("D", 1, 0, 0, [f"a{i}" for i in range(50)]), ("D", 1, 1, 1, [f"a{i}" for i in range(49)] + ["z"]), ("D", 1, 2, 2, ['"', *"bcdefgh", "i"]), ("D", 1, 3, 3, [f"c{i}" for i in range(60)]), ("D", 1, 4, 4, [f"d{i}" for i in range(40)]), ("D", 1, 5, 5, list("short"))]
    table = spark.createDataFrame(ranked, "docset_id string, doc_id long, sent_idx int, rank int, tokens array<string>")
    assert [(r["sent_idx"], r["running_tokens"]) for r in selection.greedy(table).orderBy("order_idx").collect()] == [(0, 50), (4, 90)]


def test_ilp_against_every_subset():
    random = np.random.default_rng(5)
    for _ in range(25):
        n, concepts = 8, 12
        lengths, weights = random.integers(5, 40, n), random.normal(1, 1, concepts)
        covers = [random.choice(concepts, random.integers(1, 6), replace=False) for _ in range(n)]
        value = lambda js: weights[sorted({c for j in js for c in covers[j]})].sum() if js else 0.0  # noqa: E731, B023
        best = max(value([j for j in range(n) if m >> j & 1]) for m in range(1 << n) if sum(lengths[j] for j in range(n) if m >> j & 1) <= 70)
        chosen, got, proven = selection.knapsack_cover(lengths, covers, weights, 70)
        assert proven and abs(got - best) < 1e-9 and sum(lengths[chosen]) <= 70 and abs(value(chosen) - got) < 1e-9


def test_ordering_and_vectors(spark):
    points = np.vstack([np.random.default_rng(i).normal(i * 10, 0.1, (20, 3)) for i in range(3)])
    own = ordering.lloyd(points, 3)
    assert own.tolist() == [0] * 20 + [1] * 20 + [2] * 20 and (ordering.lloyd(np.ones((4, 2))) == 0).all()
    clustered = spark.createDataFrame([("D", 0, "a", 0.9), ("D", 0, "b", 0.5), ("D", 1, "c", 0.1), ("D", 1, "a2", 0.3)], "docset_id string, cluster int, sentence string, frac double")
    chosen = spark.createDataFrame([("D", "a", 0), ("D", "b", 1), ("D", "c", 2), ("D", "gone", 3)], "docset_id string, sentence string, place int")
    assert [r["sentence"] for r in ordering.order_summary(chosen, clustered).orderBy("order_idx").collect()] == ["c", "b", "a"]
    sparse = spark.createDataFrame([("D", 1, 0, "x", 1.0), ("D", 1, 1, "x", 1.0), ("D", 1, 1, "y", 1.0), ("D", 2, 0, "y", 2.0)], "docset_id string, doc_id long, sent_idx int, term string, w double")
    v = np.array([r["v"] for r in vectors.lsa(sparse, 2).orderBy("doc_id", "sent_idx").collect()])
    assert np.allclose(v @ v.T, np.array([[1, 1, 0], [1, 2, 2], [0, 2, 4]]))
    words = spark.createDataFrame([("x", [3.0, 4.0]), ("y", [0.0, 1.0])], "term string, v array<double>")
    got = {(r["doc_id"], r["sent_idx"]): r["v"] for r in vectors.sentence_vectors_from_words(sparse.drop("w"), words, "normalized_mean").collect()}
    assert np.allclose(got[1, 1], [0.3, 0.9])
    with pytest.raises(NotImplementedError):
        vectors.encoded(sparse, None)


def test_masks_and_prompts(spark):
    rows = [("D", 1, k, f) for k, f in enumerate((0.9, 0.1, 0.8, 0.2, 0.7, 0.3, 0.5, 0.4, 0.6, 0.65))]
    scored = spark.createDataFrame(rows, "docset_id string, doc_id long, sent_idx int, f double")
    sents = spark.createDataFrame([("D", 1, k, f"s{k}", ["t"] * 3) for k in range(10)], "docset_id string, doc_id long, sent_idx int, sentence string, tokens array<string>")
    flags = masking.gap_flags(scored)
    assert {r["sent_idx"] for r in flags.where("masked").collect()} == {0, 2, 4} and {r["sent_idx"] for r in flags.where("thrown").collect()} == {1, 3, 5}
    assert masking.gap_dataset(masking.gap_pieces(flags, sents)).first()["text"] == "[MASK] s6 s7 s8 s9"
    assert masking.gap_dataset(masking.gap_pieces(flags, sents, most_tokens=5)).first()["text"] == "[MASK] s6"
    low = masking.gap_flags(scored, "as_implemented")
    assert {r["sent_idx"] for r in low.where("masked").collect()} == {1, 3} and {r["sent_idx"] for r in low.where("thrown").collect()} == {5}
    prompt = masking.reorder_prompts(masking.permuted(sents)).first()
    order = [int(x) for x in prompt["target"].removesuffix(" <eos>").split()]
    assert sorted(order) == list(range(10)) and prompt["input"] == "[shuffled] " + " ".join(f"<S{k}> s{j}" for k, j in enumerate(order)) + " [orig]"
    golds = spark.createDataFrame([("a", "t", ["x", "y"])], "id string, text string, summary array<string>")
    assert masking.summaries_of(golds).count() == 2 and masking.summaries_of(golds, 1).count() == 1


def test_realization(spark):
    place = "docset_id string, order_idx int, start int, text string, tags array<string>, features array<string>, cluster string"
    span = "docset_id string, cluster string, text string, tags array<string>, features array<string>"
    lines = ["Obama met Obama.", 'He said: "Obama met me" twice.', "Nobody came.", "President Barack Obama, 50, left."]
    sentences = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "docset_id string, order_idx int, sentence string")
    mentions = spark.createDataFrame(
        [
            ("d", 0, 0, "Obama", ["NNP"], [""], "a"),
            ("d", 0, 10, "Obama", ["NNP"], [""], "b"),
            ("d", 1, 0, "He", ["PRP"], ["Person=3"], "a"),
            ("d", 1, 10, "Obama", ["NNP"], [""], "c"),
            ("d", 3, 0, "President Barack Obama, 50", ["NNP"] * 3 + ["CD"], [""] * 4, "a"),
        ],
        place,
    )
    spans = spark.createDataFrame(
        [
            ("d", "a", "President Barack Obama, 50", ["NNP"] * 3 + ["CD"], [""] * 4),
            ("d", "a", "Obama", ["NNP"], [""]),
            ("d", "a", "he", ["PRP"], ["Person=3"]),
            ("d", "b", "Michelle Obama", ["NNP"] * 2, [""] * 2),
            ("d", "b", "Joe Biden of Delaware", ["NNP", "NNP", "IN", "NNP"], [""] * 4),  # no word of the mention's
            ("d", "c", "the Obama couple", ["DT", "NNP", "NN"], [""] * 3),
        ],
        span,
    )
    found = [r["sentence"] for r in realization.realize(sentences, mentions, spans).orderBy("order_idx").collect()]
    assert found == ["President Barack Obama met Michelle Obama.", 'He said: "[the Obama couple] met me" twice.', "Nobody came.", "Obama, left."]
    older = [r["sentence"] for r in realization.replace_referents(sentences, mentions, spans).orderBy("order_idx").collect()]
    assert older[1].startswith("President Barack Obama said") and older[3] == "President Barack Obama, left."
    rules = {(r["name"], r["allowed"], r["shared_name"]) for r in realization.verdicts(mentions, realization.names(spans)).where("cluster = 'b'").collect()}
    assert rules == {("Michelle Obama", True, True), ("Joe Biden of Delaware", False, False)}
    assert realization.realize(sentences, mentions.where("order_idx > 9"), spans).count() == 4
    sents = spark.createDataFrame([("d", 5, 0, ["a", "b"]), ("d", 4, 2, ["b", "a", "a"]), ("e", 1, 0, ["a", "b"])], "docset_id string, doc_id long, sent_idx int, tokens array<string>")
    chosen = spark.createDataFrame([("d", 0, ["a", "b"]), ("d", 1, ["c"])], "docset_id string, order_idx int, tokens array<string>")
    assert [tuple(r) for r in realization.match_sentences(chosen, sents).collect()] == [("d", 0, 4, 2)]
    phrases = spark.createDataFrame([("d", 0, 3, "x y", "a x y"), ("d", 0, 1, "z", "a x y")], "docset_id string, order_idx int, start int, text string, sentence string")
    known = spark.createDataFrame([("d", "k2", "x y", "a x y"), ("d", "k1", "x y", "a x y"), ("d", "k3", "z", "other")], "docset_id string, cluster string, text string, sentence string")
    assert [(r["start"], r["cluster"]) for r in realization.link_mentions(phrases, known).collect()] == [(3, "k1")]
    with pytest.raises(ValueError):
        realization.edits(mentions, realization.names(spans), "longest")
    with pytest.raises(NotImplementedError):
        realization.resolver(None)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "categories.txt").write_text("1. Accidents:\n   details\n2. Attacks:\n")
    (tmp_path / "topics.xml").write_text('<t><topic id="D1" category="1"><docsetA id="D1001A-A"><doc id="APW19980602.0004"/><doc id="AFP_ENG_20061002.0149"/></docsetA></topic><topic id="D2"><docsetA id="D1002A-A"><doc id="XIE19990101.0001"/></docsetA></topic></t>')
    (tmp_path / "one").write_text('<DOC><DOCNO> APW19980602.0004 </DOCNO><BODY><HEADLINE>\nBig\nflood </HEADLINE><TEXT>\n\tPERTH, Australia (AP) _ Rain fell. It\nrained on.\n\tMore &amp; more rain.\n</TEXT></BODY></DOC>')
    (tmp_path / "two").write_text('<DOCSTREAM><DOC id="APW_ENG_20041007.0256" type="story"><HEADLINE>H</HEADLINE><TEXT><P>\nOne.\n</P><P> Two  x. </P></TEXT></DOC></DOCSTREAM>')
    (tmp_path / "three").write_text("<DOC><DOCID>AFP_ENG_20061002.0149</DOCID><BODY><TEXT><P>T.</P></TEXT></BODY></DOC>")
    topics = newswire.read_topics(spark, str(tmp_path / "topics.xml"), categories=newswire.read_categories(spark, str(tmp_path / "categories.txt")))
    assert {(r["docset_id"], r["doc_id"], r["category"]) for r in topics.collect()} == {("D1001A-A", "APW19980602.0004", "Accidents"), ("D1001A-A", "AFP_ENG_20061002.0149", "Accidents"), ("D1002A-A", "XIE19990101.0001", "None")}
    listing = spark.createDataFrame([("aquaint/apw/1998/19980602_APW_ENG",), ("tac/afp_eng/20061002",)], "path string")
    assert newswire.missing_count(newswire.with_paths(topics, listing)) == 1
    one, two, three = (newswire.read_corpus(spark, str(tmp_path / x), i + 1) for i, x in enumerate(("one", "two", "three")))
    r = one.first()
    assert (r["doc_id"], r["date"], r["headline"]) == ("APW19980602.0004", "19980602", "Big flood") and r["paragraphs"][-1] == "More & more rain."
    assert two.first()["paragraphs"] == ["One.", "Two x."] and three.first()["headline"] == "NONE"
    assert newswire.wanted([one, two, three], topics).count() == 2
    (tmp_path / "docsets.json").write_text('{"D1001A-A": {"x": ["19980602", "1", "H", [[["A", "b", "."], ["C"]], [["d"]]]]}}')
    loaded = files.read_docsets(spark, str(tmp_path / "docsets.json"))
    assert [(r["para_idx"], r["sent_idx"], r["tokens"]) for r in files.body_sentences(loaded).orderBy("sent_idx").collect()] == [(0, 0, ["A", "b", "."]), (0, 1, ["C"]), (1, 2, ["d"])]
    text = loaded.select(files.document_text(F.col("date"), F.col("category"), F.col("headline"), F.col("body"))).first()[0]
    assert text == "DATE_TIME: 19980602\nCATEGORY: 1\nHEADLINE: H\n\n['A', 'b', '.']\n['C']\n\n['d']\n\n"
    files.write_docsets(loaded, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    folder = tmp_path / "sums"
    folder.mkdir()
    (folder / "D1001-A.M.100.A.2").write_bytes("café “x”".encode("cp1252"))
    (folder / "other").write_text("no")
    s = files.read_summaries(spark, str(folder)).first()
    assert (s["base_id"], s["method"], s["text"]) == ("D1001-A.M.100.A", "2", "café “x”")
    config = files.rouge_config(spark.createDataFrame([("D1001-A.M.100.A", "1")], "base_id string, method string"), spark.createDataFrame([("D1001-A.M.100.A", "B")], "base_id string, annotator string"), "p", "m").first()["eval"]
    assert '<P ID="1">D1001-A.M.100.A.1</P>' in config and '<M ID="B">D1001-A.M.100.A.B</M>' in config
    split = spark.createDataFrame([("a", "t", "s", "train"), ("b", "t", "s", "test")], "id string, text string, summary string, split string")
    files.write_split_dataset(split, str(tmp_path / "ds"))
    assert files.read_split_dataset(spark, str(tmp_path / "ds")).where("split = 'train'").count() == 1
    files.write_generations(spark.createDataFrame([("i", ["a foo] b"])], "input string, predictions array<string>"), str(tmp_path / "gen"))
    assert spark.read.json(str(tmp_path / "gen")).first()["predictions"] == ["a b"]


def test_ilp_query_searches_as_far_as_the_operator(spark, monkeypatch):
    from gistmill.plans import registry

    given = []
    monkeypatch.setattr(selection, "ilp_summary", lambda *a, **named: given.append((len(a), named)) or spark.range(1))
    registry.queries()["ilp_summary"](spark, "/root/testdata/sf0.001")
    assert given == [(3, {})]


def test_detokenizers_and_golds(spark, tmp_path):
    one = lambda style, *toks: spark.range(1).select(T.detokenizer(style)(F.array(*map(F.lit, toks)))).first()[0]
    assert one("treebank", "``", "I", "'d", "'ve", "gone", ",", "''", "she", "did", "n't", "say", "(", "now", ")", ".") == '"I\'d\'ve gone," she didn\'t say (now).'
    assert one("moses", "He", "said", '"', "no", ",", "it", "'s", "fine", '"', "(", "twice", ")", "!") == 'He said "no, it\'s fine" (twice)!'
    assert one("moses") == "" and one(False, "a", ".") == ["a", "."]
    (tmp_path / "D1001-A.M.100.A.B").write_bytes(b"caf\\xe9 one\ntwo \\u2014 x\n")
    (tmp_path / "D1002-B.M.100.B.C").write_bytes("broken \\x\n".encode())
    found = {r["docset_id"]: r["text"] for r in files.read_golds(spark, str(tmp_path), escapes=True).collect()}
    assert found == {"D1001-A": "café one two — x", "D1002-B": "broken \\x"}
    assert {r["text"] for r in files.read_golds(spark, str(tmp_path)).collect()} == {"caf\\xe9 one two \\u2014 x", "broken \\x"}


def test_greedy_against_plain_code(spark):
    """Any chosen sentence may keep another out, not only the one before."""
    random = np.random.default_rng(11)
    vocab = [f"v{i}" for i in range(14)]
    rows = [(f"D{d}", d, k, k, random.choice(vocab, int(random.integers(5, 13)), replace=False).tolist()) for d in range(12) for k in range(40)]
    table = spark.createDataFrame(rows, "docset_id string, doc_id long, sent_idx int, rank int, tokens array<string>")
    found = sorted((r["docset_id"], r["order_idx"], r["sent_idx"]) for r in selection.greedy(table, min_jaccard_dist=0.6).collect())
    plain = []
    for d in range(12):
        chosen, used = [], 0
        for _, _, k, _, toks in [r for r in rows if r[1] == d and len(r[4]) > 7][:25]:
            near = any(1 - len(set(toks) & set(x)) / len(set(toks) | set(x)) <= 0.6 for x in chosen)
            if used < 100 and not near and used + len(toks) <= 100:
                plain.append((f"D{d}", len(chosen), k))
                chosen.append(toks)
                used += len(toks)
    assert found == sorted(plain) and len(plain) > 12


def test_summary_files_of_methods(spark):
    from gistmill.plans import registry

    for name, method in (("ilp_summary_files", "5"), ("lexrank_summary_files", "2")):
        found = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert found and all(r["file"].endswith("." + method) and r["text"] for r in found)


def test_lsa_against_plain_code(spark):
    random = np.random.default_rng(12)
    dense = random.random((9, 6)) * (random.random((9, 6)) > 0.4)
    dense[:, 0] += 0.1
    rows = [("D", 1, i, f"t{j}", float(dense[i, j])) for i in range(9) for j in range(6) if dense[i, j]]
    found = np.array([r["v"] for r in vectors.lsa(spark.createDataFrame(rows, "docset_id string, doc_id long, sent_idx int, term string, w double"), 3).orderBy("sent_idx").collect()])
    values, directions = np.linalg.eigh(dense.T @ dense)
    plain = dense @ directions[:, ::-1][:, :3]
    assert np.allclose(np.abs(found), np.abs(plain)) and np.allclose((found**2).sum(0), values[::-1][:3])


def test_clusters_against_every_assignment():
    """Of points in two clear groups the best of all ways to cut them; of any others a cut that no single step betters, which is
    all that k-means promises."""
    random = np.random.default_rng(13)
    for apart in (0.0, 6.0):
        for _ in range(10):
            points = random.normal(size=(8, 2)) + np.repeat([[0.0], [apart]], 4, axis=0)
            cost = lambda own: sum(((points[own == c] - points[own == c].mean(0)) ** 2).sum() for c in set(own.tolist()))  # noqa: E731, B023
            own = ordering.lloyd(points, 2)
            centres = np.stack([points[own == c].mean(0) for c in (0, 1)])
            assert (((points[:, None] - centres) ** 2).sum(2).argmin(1) == own).all()
            if apart:
                assert abs(cost(own) - min(cost(np.array([m >> i & 1 for i in range(8)])) for m in range(1, 128))) < 1e-9


def test_trimmed_and_written_texts(spark, tmp_path):
    rows = [("D", k, ["w"] * n) for k, n in enumerate((5, 4, 3))]
    trimmed = selection.trim_summary(spark.createDataFrame(rows, "docset_id string, order_idx int, tokens array<string>"), 9)
    assert sorted(r["order_idx"] for r in trimmed.collect()) == [0, 1]
    sents = spark.createDataFrame([("D", 1, 0, "a"), ("D", 1, 1, "b"), ("D", 2, 0, "c")], "docset_id string, doc_id long, sent_idx int, sentence string")
    assert {(r["sentence"], r["previous"]) for r in ordering.positions_before(sents).collect()} == {("a", None), ("b", "a"), ("c", None)}
    files.write_texts(spark.createDataFrame([("x.1", "one"), ("x.2", "two\nlines")], "file string, text string"), str(tmp_path / "out"))
    assert {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("file=*/*.txt")} == {"file=x.1": "one\n", "file=x.2": "two\nlines\n"}
    assert set(vectors.STRATEGIES) == {"lsa", "words", "encoder"}


def test_one_file_of_each_document(spark):
    listing = spark.createDataFrame([("/a/APW19980101.0001.xml",), ("/b/NYT19990202.0002.xml",), ("/c/NYT19990202.0002.gz",)], "path string")
    wanted = spark.createDataFrame([("APW19980101.0001",), ("NYT19990202.0002",), ("XIE20000101.0003",)], "doc_id string")
    found = {r["doc_id"]: (r["path"], r["files"]) for r in newswire.only_file(listing, wanted).collect()}
    assert found == {"APW19980101.0001": ("/a/APW19980101.0001.xml", 1), "NYT19990202.0002": ("/b/NYT19990202.0002.xml", 2), "XIE20000101.0003": (None, 0)}
