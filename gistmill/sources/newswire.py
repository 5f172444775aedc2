"""Readers of topic lists and newswire corpora, and the rules that say where a document lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import text as T

#: Last periods (YYYYMMDD) of the first and of the second corpus.
FIRST_UNTIL, SECOND_UNTIL = 20009999, 20060399

_DOC_ID = r"^([A-Za-z]*_[A-Za-z]*|[A-Za-z]*?)_?(\d+\.\d+)"


def news_org(doc_id: Column) -> Column:
    return F.regexp_extract(doc_id, r"^([A-Za-z]*(?:_[A-Za-z]+)?)_?\d+\.\d+", 1)


def period(doc_id: Column) -> Column:
    return F.regexp_extract(doc_id, r"(\d+)\.\d+", 1).cast("int")


def corpus_of(doc_id: Column) -> Column:
    """1, 2 or 3 by the document's period."""
    at = period(doc_id)
    return F.when(at <= FIRST_UNTIL, 1).when(at <= SECOND_UNTIL, 2).otherwise(3)


def path_of(doc_id: Column, roots: tuple[str, str, str] = ("aquaint", "aquaint2", "tac")) -> Column:
    """The file (for the third corpus the folder) that holds a document."""
    org, at = news_org(doc_id), period(doc_id)
    code = F.when(org == "XIE", "XIN").otherwise(org)
    code = F.when(code == "NYT", code).otherwise(F.concat(code, F.lit("_ENG")))
    first = F.concat_ws("/", F.lit(roots[0]), F.lower(org), F.floor(at / 10000).cast("string"), F.concat_ws("_", at.cast("string"), code))
    second = F.concat_ws("/", F.lit(roots[1]), F.lower(org), F.concat(F.lower(org), F.lit("_"), F.floor(at / 100).cast("string"), F.lit(".xml")))
    third = F.concat_ws("/", F.lit(roots[2]), F.lower(org), at.cast("string"))
    return F.when(at <= FIRST_UNTIL, first).when(at <= SECOND_UNTIL, second).otherwise(third)


def only_file(listing: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id, path, files: the files (column path) whose name holds the document's name; one is right, so check files = 1."""
    named = listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    named = named.withColumn("doc_id", F.regexp_extract("name", r"([A-Za-z_]+\d+\.\d+)", 1))
    met = doc_ids.select("doc_id").join(named, "doc_id", "left")
    return met.groupBy("doc_id").agg(F.min("path").alias("path"), F.count("path").alias("files"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """category, name from lines such as '1. Accidents:'."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d\..*:$"))
    return lines.select(F.regexp_extract("value", r"^(\d)\. ?(.*):$", 1).alias("category"), F.regexp_extract("value", r"^(\d)\. ?(.*):$", 2).alias("name"))


def read_topics(spark: SparkSession, path: str, which: str = "A", categories: DataFrame | None = None) -> DataFrame:
    """docset_id, doc_id, category of the docsets `which` of a topic list; a topic without a category has "None"."""
    docset = f"docset{which}"
    schema = f"_id string, _category string, {docset} struct<_id: string, doc: array<struct<_id: string, _VALUE: string>>>"
    topics = spark.read.format("xml").option("rowTag", "topic").schema(schema).load(path)
    rows = topics.select(F.col(f"{docset}._id").alias("docset_id"), F.explode(f"{docset}.doc").alias("doc"), F.col("_category").alias("category"))
    rows = rows.select("docset_id", F.col("doc._id").alias("doc_id"), "category").where("docset_id is not null")
    if categories is None:
        return rows.withColumn("category", F.coalesce("category", F.lit("None")))
    return rows.join(F.broadcast(categories), "category", "left").select("docset_id", "doc_id", F.coalesce("name", F.lit("None")).alias("category"))


def with_paths(topics: DataFrame, listing: DataFrame) -> DataFrame:
    """Topics with their files; missing marks documents whose file the listing (column path) has not."""
    known = listing.select("path").distinct().withColumn("found", F.lit(True))
    return topics.withColumn("path", path_of(F.col("doc_id"))).join(known, "path", "left").withColumn("missing", F.col("found").isNull()).drop("found")


def missing_count(rows: DataFrame) -> int:
    return rows.where("missing").count()


def _documents(path_rows: DataFrame, corpus: int) -> DataFrame:
    """doc_id, headline, marked paragraphs and plain body of whole files (column value), one row a DOC element."""
    docs = path_rows.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<DOC\b[^>]*>.*?</DOC>"), F.lit(0))).alias("doc"))
    part = lambda tag: F.regexp_extract("doc", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    ident = F.trim(part("DOCNO")) if corpus == 1 else F.regexp_extract("doc", r'(?is)<DOC\b[^>]*\bid="([^"]*)"', 1) if corpus == 2 else F.trim(part("DOCID"))
    body = part("TEXT")
    return docs.select(
        ident.alias("doc_id"),
        T.headline(part("HEADLINE")).alias("headline"),
        F.regexp_extract_all(body, F.lit(r"(?is)<P\b[^>]*>(.*?)</P>"), F.lit(1)).alias("marked"),
        body.alias("body"),
    )


def _unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def read_corpus(spark: SparkSession, path: str, corpus: int) -> DataFrame:
    """corpus, doc_id, date, headline, paragraphs of all documents in files of the first (DOCNO), second (DOC id) or third
    (one DOC with DOCID a file) corpus. Paragraphs are cleaned; unmarked bodies are split by rule; broken markup around
    documents does no harm."""
    if corpus not in (1, 2, 3):
        raise ValueError("corpus is 1, 2 or 3")
    rows = _documents(spark.read.text(path, wholetext=True), corpus)
    plain = F.when(F.size("marked") > 0, F.col("marked")).otherwise(T.manual_paragraphs(F.col("body")))
    cleaned = F.filter(F.transform(plain, lambda p: T.clean_paragraph(_unescaped(p))), lambda p: ~T.is_dropped(p))
    return rows.select(F.lit(corpus).alias("corpus"), "doc_id", T.date_of(F.col("doc_id")).alias("date"), _unescaped(F.col("headline")).alias("headline"), cleaned.alias("paragraphs"))


def wanted(corpora: list[DataFrame], topics: DataFrame) -> DataFrame:
    """The topics' documents out of several corpora."""
    every = corpora[0]
    for more in corpora[1:]:
        every = every.unionByName(more)
    return topics.join(every.dropDuplicates(["doc_id"]), "doc_id")
