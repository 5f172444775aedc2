"""Readers and writers of docset JSON, summaries, references, datasets, score reports and ROUGE configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import text as T

DOCSETS = "map<string, map<string, struct<date: string, category: string, headline: string, body: array<array<array<string>>>>>>"


def read_docsets(spark: SparkSession, path: str) -> DataFrame:
    """docset_id, doc_id, date, category, headline, body from {docset: {doc: [date, category, headline, body]}}."""
    raw = spark.read.text(path, wholetext=True)
    outer = raw.select(F.explode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("docset_id", "docs"))
    rows = outer.select("docset_id", F.explode("docs").alias("doc_id", "d"))
    body = F.from_json(F.col("d")[3], "array<array<array<string>>>")
    return rows.select("docset_id", "doc_id", F.col("d")[0].alias("date"), F.col("d")[1].alias("category"), F.col("d")[2].alias("headline"), body.alias("body"))


def body_sentences(docsets: DataFrame) -> DataFrame:
    """docset_id, doc_id, para_idx, sent_idx, tokens of canonical documents."""
    flat = F.flatten(F.transform("body", lambda p, i: F.transform(p, lambda s: F.struct(i.alias("para_idx"), s.alias("tokens")))))
    return docsets.select("docset_id", "doc_id", F.posexplode(flat).alias("sent_idx", "s")).select("docset_id", "doc_id", "s.para_idx", "sent_idx", "s.tokens")


def write_docsets(rows: DataFrame, path: str) -> None:
    """A line of JSON a document, partitioned by docset."""
    rows.write.partitionBy("docset_id").json(path)


def document_text(date: Column, category: Column, headline: Column, body: Column) -> Column:
    """Header lines, a blank line, then a line of tokens a sentence and a blank line after each paragraph."""
    quoted = lambda t: F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))
    line = lambda s: F.concat(F.lit("["), F.array_join(F.transform(s, quoted), ", "), F.lit("]\n"))
    paragraphs = F.array_join(F.transform(body, lambda p: F.concat(F.array_join(F.transform(p, line), ""), F.lit("\n"))), "")
    return F.concat(F.lit("DATE_TIME: "), date, F.lit("\nCATEGORY: "), category, F.lit("\nHEADLINE: "), headline, F.lit("\n\n"), paragraphs)


def llm_records(docs: DataFrame, golds: DataFrame) -> DataFrame:
    """id, category, title (of the last document), text (sentences of each document), summary (golds of the id).

    docs: docset_id, pos, corpus, headline, sentences; golds: docset_id, text.
    """
    packed = F.array_sort(F.collect_list(F.struct("pos", "sentences")))
    each = docs.groupBy("docset_id").agg(F.min_by("corpus", "pos").alias("category"), F.max_by("headline", "pos").alias("title"), F.transform(packed, lambda x: x["sentences"]).alias("text"))
    gold = golds.groupBy("docset_id").agg(F.array_sort(F.collect_list("text")).alias("summary"))
    return each.join(gold, "docset_id", "left").select(F.col("docset_id").alias("id"), "category", "title", "text", F.coalesce("summary", F.array().cast("array<string>")).alias("summary"))


def read_summaries(spark: SparkSession, folder: str, encoding: str = "cp1252") -> DataFrame:
    """file, base_id, method, text of summary files; Spark's readers know no cp1252, so Python decodes the bytes."""

    @F.pandas_udf("string")
    def decoded(content):
        return content.map(lambda b: bytes(b).decode(encoding, "replace"))

    rows = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), decoded("content").alias("text"))
    rows = rows.where(F.col("file").rlike(r"^D1\d\d\d-[A-Z]\.M\.100\.\w\.\w+$"))
    return rows.select("file", F.regexp_extract("file", r"^(.*)\.\w+$", 1).alias("base_id"), F.regexp_extract("file", r"\.(\w+)$", 1).alias("method"), "text")


def read_golds(spark: SparkSession, folder: str, escapes: bool = False) -> DataFrame:
    """file, docset_id, text of gold summaries: lines joined by blanks; the docset is the name's stem and letter. With escapes,
    bytes are Latin-1 in which a backslash starts an escape; a text with a broken one stays as it is."""

    @F.pandas_udf("string")
    def decoded(content):
        def one(raw):
            try:
                return bytes(raw).decode("unicode_escape" if escapes else "utf-8")
            except UnicodeDecodeError:
                return bytes(raw).decode("latin-1")

        return content.map(one)

    rows = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), decoded("content").alias("text"))
    return rows.select("file", F.regexp_extract("file", r"^(D\d+[A-Z]?-[A-Z])", 1).alias("docset_id"), F.regexp_replace(F.regexp_replace("text", r"\n+$", ""), "\n", " ").alias("text"))


def write_texts(rows: DataFrame, path: str, key: str = "file", text: str = "text") -> None:
    """A folder for each key with its text."""
    rows.select(key, text).write.partitionBy(key).text(path)


def summary_texts(sents: DataFrame, method: int, style: bool | str = True) -> DataFrame:
    """file, text: the chosen sentences (docset_id, order_idx, tokens) of each docset, a line each, made by T.detokenizer(style)."""
    packed = F.array_sort(F.collect_list(F.struct("order_idx", "tokens")))
    lines = F.array_join(F.transform(packed, lambda x: T.detokenizer(style)(x["tokens"])), "\n")
    return sents.groupBy("docset_id").agg(lines.alias("text")).select(T.summary_file_name(F.col("docset_id"), F.lit(str(method))).alias("file"), "text")


def write_split_dataset(rows: DataFrame, path: str) -> None:
    """train, validation and test rows (column split) as JSON."""
    rows.write.partitionBy("split").json(path)


def read_split_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string, summary string, split string").json(path)


def write_generations(rows: DataFrame, path: str) -> None:
    """Lines of {input, predictions}; leftovers of prompt marks go."""
    rows.select("input", F.transform("predictions", T.clean_generation).alias("predictions")).write.json(path)


def rouge_config(peers: DataFrame, models: DataFrame, peer_root: str, model_root: str) -> DataFrame:
    """base_id, eval: an EVAL element for each base id. peers: base_id, method; models: base_id, annotator."""
    p = F.array_sort(F.collect_set("method"))
    line = lambda tag, x: F.concat(F.lit(f'<{tag} ID="'), x, F.lit('">'), F.col("base_id"), F.lit("."), x, F.lit(f"</{tag}>"))
    a = peers.groupBy("base_id").agg(p.alias("methods"))
    b = models.groupBy("base_id").agg(F.array_sort(F.collect_set("annotator")).alias("annotators"))
    met = a.join(b, "base_id")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit('<EVAL ID="'), F.col("base_id"), F.lit('">')),
        F.lit(f"<PEER-ROOT>\n{peer_root}\n</PEER-ROOT>\n<MODEL-ROOT>\n{model_root}\n</MODEL-ROOT>"),
        F.lit('<INPUT-FORMAT TYPE="SPL">\n</INPUT-FORMAT>\n<PEERS>'),
        F.array_join(F.transform("methods", lambda x: line("P", x)), "\n"),
        F.lit("</PEERS>\n<MODELS>"),
        F.array_join(F.transform("annotators", lambda x: line("M", x)), "\n"),
        F.lit("</MODELS>\n</EVAL>"),
    )
    return met.select("base_id", text.alias("eval"))
