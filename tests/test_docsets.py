"""Queries that work on whole docsets and documents, against SQL or plain code on odd inputs; each test names its findings."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.functions import split
from gistmill.functions import text as T
from gistmill.operators import docsets, lexrank, ordering, rouge, selection, similarity, tables, tfidf, vectors
from gistmill.plans import registry, texts

SF = "/root/testdata/sf0.001"
WORDS = ("sentence_cosine_graph", "similarity_column_normalized", "lexrank_fixed_as_implemented", "tfidf_sentence", "ngram_trigram", "ngram_bigram_unpadded", "ngram_unigram", "rouge_gold_mean", "ilp_concept_weights", "gap_truncate", "tf_sentence", "df_sentence", "ilp_incidence", "gap_flags_documented", "rouge2", "rouge2_loo", "rouge_best_reference", "embedding_cosine")


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    """Documents without text, words or a short sentence, with marks, headers, copies, letters beyond ASCII, and one long sentence."""
    folder = tmp_path_factory.mktemp("odd")
    said = ["", None, "...", "& &.\nA1 & b_2! ", "WASHINGTON (AP) _ Gov. Smith  spoke (212) 555-0100 .\nCOPYRIGHT 1998 BY WORLDSOURCES x\nIt is 3.14 now. Yes!  No? end", "Über Öl İs ŞÖ. naïve Über öl.\tTab here.", "the of and. The of.", "x " * 3000 + "y.", "Same words here. Same words here.\n" * 4, "Same words here. Same words here.\n" * 4, '"Open quote. closed" one.']
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate([*said * 3, "A lonely zebra."])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    v = np.random.default_rng(3).normal(size=(60, 64)).astype("float32")
    v[7], v[9] = 0, v[8]
    spark.createDataFrame([(k, [float(x) for x in e], k % 2) for k, e in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", WORDS)
def test_odd_documents_as_their_sql(spark, odd, monkeypatch, name):
    """Groups of a docset, blocks of a few pairs and tiles of a few vectors too."""
    for module, most in ((docsets, "GROUP_BYTES"), (similarity, "BLOCK"), (rouge, "BLOCK"), (similarity, "TILE")):
        monkeypatch.setattr(module, most, 8)
    a, b = registry.queries()[name](spark, odd[0]).toPandas(), odd[1].sql(registry.oracle_sql()[name]).df()
    columns = sorted(b.columns)
    a, b = (sorted(x[columns].astype(str).itertuples(index=False, name=None)) for x in (a, b))
    assert b and set(a) ^ set(b) == set() and a == b


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_of_words(spark):
    """What lies in a document is counted there; F16, F21 to F23: no join of word rows."""
    for name in ("ngram_unigram", "ngram_bigram", "ngram_trigram", "ngram_bigram_unpadded", "tf_sentence", "ilp_incidence", "gap_flags_documented", "gap_truncate", "gap_dataset", "rouge2_loo"):
        assert "HashAggregate" not in exchanges(registry.queries()[name](spark, SF)), name
    for name in ("tfidf_sentence", "tfidf_docset", "ilp_concept_weights", "rouge_gold_mean", "sentence_cosine_graph", "lexrank_grid", "ilp_summary", "lsa_project"):
        assert "Join" not in exchanges(registry.queries()[name](spark, SF)), name


def test_terms_asked_once_a_group(spark, odd):
    """A term goes once a group, and comes back only where other groups hold it too."""
    rows = docsets.bodies(texts.docs(spark, odd[0])).withColumn("g", (F.col("docset_id") == "s1-0").cast("int"))
    got = [(r["g"], r["term"], r["n"]) for r in docsets.asked(rows, docsets.ALL, "sentence").collect()]
    want = dict(odd[1].sql(registry.oracle_sql()["df_sentence"]).df()[["term", "df"]].itertuples(index=False, name=None))
    assert len(got) == len(set(got)) and all(n == want[t] for _, t, n in got if t)
    assert {t for _, t, _ in got if t} < set(want)


def test_splitting_in_both_forms(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet").where("text is not null")
    clean = F.filter(F.transform(F.split("text", "\n"), T.clean_paragraph), lambda p: ~T.is_dropped(p))
    for r in docs.select("text", F.flatten(F.transform(clean, T.sentences)).alias("s")).collect():
        assert [s for _, s in split.sentences(r["text"])] == r["s"]


def test_pairs_and_walks_against_dense_matrices():
    """F4 to F6, F9, F10, F13, F18, F19."""
    random = np.random.default_rng(1)
    dense = random.random((60, 40)) * (random.random((60, 40)) > 0.8)
    dense[5] = 0
    s, c = np.nonzero(dense)
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    near = (dense / np.where(norm > 0, norm, 1)) @ (dense / np.where(norm > 0, norm, 1)).T
    i, j, w = similarity.half_edges(s, c, dense[s, c], 60, 0.3)
    x, y = np.nonzero(np.triu(near, 1) >= 0.3)
    assert (i == x).all() and (j == y).all() and np.allclose(w, near[x, y])
    m = np.where((near >= 0.3) & ~np.eye(60, dtype=bool), near, 0)
    for mode in ("documented", "as_implemented"):
        total = m.sum(1, keepdims=True)
        move = 0.15 / 60 + 0.85 * (np.where(total > 0, m / np.where(total > 0, total, 1), 1 / 60) if mode == "documented" else m / 60)
        p = np.full(60, 1 / 60)
        for _ in range(300):
            p = move.T @ p
        walk = lexrank.Walk(60, i, j, w, mode)
        assert np.allclose(walk.converged(lexrank.Config(error=1e-15, mode=mode)), p / p.max()) and np.allclose(walk.fixed(300), p / p.max())


def test_projections_of_many_vectors():
    """Of more vectors than DENSE the first directions come from a Krylov space."""
    random = np.random.default_rng(2)
    dense = random.random((500, 450)) * (random.random((500, 450)) > 0.95)
    dense[:3, :], dense[:3, :3] = 0, 9 * np.eye(3)  # equal singular values
    s, c = np.nonzero(dense)
    at, v = vectors.project(s, c, dense[s, c], 8)
    values = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(np.linalg.norm(v, axis=0), values[:8], atol=1e-9)
    assert np.allclose(v.T @ v, np.diag(values[:8] ** 2), atol=1e-6)
    own = dense[at] @ dense[at].T
    assert np.abs(own @ v - v * values[:8] ** 2).max() < 1e-6 * values[0] ** 2


def test_every_sentence_may_be_chosen(spark):
    """no sentence is left out for its rank, and the order is that of the operators on tables."""
    rows = [("D", 1, k, k, [f"a{i}" for i in range(20)] + [f"b{k}"]) for k in range(30)] + [("D", 2, 0, 30, [f"c{i}" for i in range(30)])]
    table = spark.createDataFrame(rows, "docset_id string, doc_id long, sent_idx int, rank int, tokens array<string>")
    assert [r["doc_id"] for r in selection.greedy(table, topk=None).orderBy("order_idx").collect()] == [1, 2]
    every = texts.sents(spark, SF)
    content = tables.terms(every, stopwords=False)
    sparse = tfidf.sentence_vectors(content, tfidf.idf(tfidf.tf(content, "sentence"), "sentence")).cache()
    ranked = lexrank.ranked(lexrank.converged(sparse, every)).join(every.select("doc_id", "sent_idx", "sentence", "tokens"), ["doc_id", "sent_idx"])
    chosen = selection.greedy(ranked, topk=None).cache()
    keys = ("docset_id", "order_idx", "doc_id", "sent_idx", "running_tokens")
    assert {tuple(r[k] for k in keys) for r in chosen.collect()} == {tuple(r[k] for k in keys) for r in registry.queries()["greedy_extract"](spark, SF).collect()}
    key = F.col("doc_id") * 1_000_000 + F.col("sent_idx")
    clusters = ordering.kmeans(vectors.lsa(sparse, 16).withColumn("s", key), "docset_id", "s")
    placed = tables.with_position(texts.sents(spark, SF)).withColumn("s", key).join(clusters, ["docset_id", "s"])
    named = chosen.join(texts.sents(spark, SF).select("doc_id", "sent_idx", "sentence"), ["doc_id", "sent_idx"]).select("docset_id", "sentence", F.col("order_idx").alias("place"))
    keys = ("docset_id", "order_idx", "sentence", "cluster", "place")
    assert {tuple(r[k] for k in keys) for r in ordering.order_summary(named, placed).collect()} == {tuple(r[k] for k in keys) for r in registry.queries()["lexrank_summary_ordered"](spark, SF).collect()}


def test_ilp_of_many_sentences_to_proof(spark):
    """hundreds of sentences are solved to proof, as by a plain table over lengths where no concept is shared."""
    random = np.random.default_rng(4)
    lengths, weights = random.integers(25, 60, 400), random.random(1200)
    covers = np.split(np.arange(1200), 400)
    best = np.zeros(101)
    for size, held in zip(lengths, covers, strict=True):
        best[size:] = np.maximum(best[size:], best[:-size] + weights[held].sum())
    _, total, proven = selection.knapsack_cover(lengths, covers, weights, 100)
    assert proven and abs(total - best[100]) < 1e-9
    sents, rows = texts.sents(spark, SF), tables.terms(texts.sents(spark, SF), stopwords=False)
    counted = tfidf.tf(rows, "docset")
    incident = selection.incidence(rows)
    plain = selection.ilp_summary_of_tables(sents, incident, selection.concept_weights(incident, tfidf.weights(counted, tfidf.idf(counted, "docset"))))
    found = registry.queries()["ilp_summary"](spark, SF).collect()
    keyed = lambda rows: {(r["docset_id"], r["doc_id"], r["sent_idx"], round(r["objective"], 6), r["optimal"]) for r in rows}
    assert found and keyed(found) == keyed(plain.collect())


def test_report_rounds_as_printf(spark):
    """0.000125 and 0.265005 lie on the one side of the middle as decimals and on the other as they are stored."""
    values = [0.000125, 0.265005, 0.5, 1.0, 0.000005, 0.000015, 123.4]
    table = spark.createDataFrame([("m", "rouge-1", f"f{k}", x, x, x) for k, x in enumerate(values)], "method string, rouge string, file string, p double, r double, f double")
    lines = {r["file"]: r["line"] for r in rouge.report_lines(table).collect()}
    for k, x in enumerate(values):
        assert lines[f"f{k}"] == duckdb.sql(f"select printf('m ROUGE-1 Eval f{k} R:%6.5f P:%6.5f F:%6.5f', {x!r}::double, {x!r}::double, {x!r}::double)").fetchall()[0][0]


def test_stemmed_scores_as_the_operator(spark):
    """F33."""
    table = spark.createDataFrame([("A", 1, ["Dogs", "chased", "&", "cats", "."]), ("A", 2, ["dog", "chasing", "cats"])], "docset_id string, i int, tokens array<string>")
    one, two = table.where("i = 1"), table.where("i = 2").withColumnRenamed("i", "j")
    for how in ({"n": 1}, {"n": 2, "stem": True}, {"n": 1, "stem": True, "limit": 2}):
        r = rouge.scores(one, two, ["docset_id"], ["i"], ["j"], **how).first()
        own, other = (rouge.plain_counts(x.first()["tokens"], **how) for x in (one, two))
        assert np.allclose(rouge.plain_scores(own, other), (r["p"], r["r"], r["f"]))


def test_transform_asks_only_for_the_items_terms(spark):
    """F30."""
    assert "LeftSemi" in exchanges(texts.term_counts(spark, SF, "sentence").join(spark.createDataFrame([("the",)], "term string"), "term", "left_semi"))
    rows = registry.queries()["tfidf_transform"](spark, SF).collect()
    assert rows and pa.array([r["w"] for r in rows]).null_count == 0
