"""The library's queries against their SQL, over the smallest tables."""

import duckdb
import pytest

from gistmill.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ("sentence_split", "clean_paragraphs", "doc_id_date", "corpus_route", "tf_docset", "idf_documented", "tfidf_docset", "ngram_bigram", "lead_k", "graph_degree", "lexrank_fixed_documented", "order_summary", "rouge1", "gap_dataset", "reorder_prompt", "jaccard_neighbours", "summary_files", "rouge_config", "llm_records", "copyright_filter", "rouge_report", "rouge1_limited", "summary_sentence_match", "masked_mean_pool", "tfidf_transform", "lexrank_converged", "lexrank_grid", "detokenized", "rouge_report_averages")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "orders", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, tables, name):
    a, b = registry.queries()[name](spark, SF).toPandas(), tables.sql(registry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda x: x[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(a).equals(plain(b))
