"""The tables that other operators read: documents in docsets, paragraphs, sentences, terms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import split
from gistmill.functions import text as T

SENTENCES = (("docset_id", pa.string()), ("doc_id", pa.int64()), ("para_idx", pa.int32()), ("sent_idx", pa.int32()), ("sentence", pa.string()), ("tokens", pa.list_(pa.string())))


def docset_documents(documents: DataFrame, size: int = 200) -> DataFrame:
    """docset_id (source and block of ids), doc_id, lang, text."""
    block = F.floor(F.col("doc_id") / size).cast("bigint")
    return documents.select(F.concat_ws("-", "source", block.cast("string")).alias("docset_id"), "doc_id", "lang", "text")


def paragraphs(docs: DataFrame) -> DataFrame:
    """docset_id, doc_id, para_idx, clean: cleaned paragraphs, those under copyright too."""
    split = docs.select("docset_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "para"))
    return split.select("docset_id", "doc_id", "para_idx", T.clean_paragraph(F.col("para")).alias("clean"))


def sentences(docs: DataFrame) -> DataFrame:
    """docset_id, doc_id, para_idx, sent_idx (from 0 within a document), sentence, tokens. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in SENTENCES]
                for docset, doc, text in zip(*(x.to_pylist() for x in batch.slice(begin, 256).columns), strict=True):
                    for at, (para, sentence) in enumerate(split.sentences(text)):
                        for column, x in zip(out, (docset, doc, para, at, sentence, split.tokens(sentence)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(out, SENTENCES, strict=True)], [name for name, _ in SENTENCES])

    return docs.select("docset_id", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "docset_id string, doc_id long, para_idx int, sent_idx int, sentence string, tokens array<string>")


def first_documents(docs: DataFrame) -> DataFrame:
    """Of each docset the document of the smallest doc_id that has a sentence; chosen by ids, before any sentence is split."""
    says = F.exists(F.transform(F.split("text", "\n"), T.clean_paragraph), lambda p: ~T.is_dropped(p) & p.rlike(r"[^.!?\s]"))
    first = docs.where(says).groupBy("docset_id").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(first, ["docset_id", "doc_id"])


def terms(sents: DataFrame, n: int = 1, padded: bool = True, stopwords: bool = True) -> DataFrame:
    """docset_id, doc_id, sent_idx, term: a row an occurrence of an n-gram of lower-cased words."""
    kept = T.words(F.col("tokens"))
    kept = kept if stopwords else T.drop_stopwords(kept)
    return sents.select("docset_id", "doc_id", "sent_idx", F.explode(T.ngrams(kept, n, padded) if n > 1 else kept).alias("term"))


def with_position(sents: DataFrame) -> DataFrame:
    """frac: the sentence's index over its document's number of sentences."""
    return sents.withColumn("frac", F.col("sent_idx") / F.count(F.lit(1)).over(Window.partitionBy("docset_id", "doc_id")))


def sentence_index(sents: DataFrame) -> DataFrame:
    """docset_id, sentence, frac: of equal sentences of a docset the least fraction."""
    return with_position(sents).groupBy("docset_id", "sentence").agg(F.min("frac").alias("frac"))


def load_documents(docs: DataFrame, sentences_are_documents: bool = True) -> DataFrame:
    """Token lists: a row a sentence, or a row a document with its sentences' tokens one after another."""
    sents = sentences(docs)
    if sentences_are_documents:
        return sents.select("docset_id", "doc_id", "sent_idx", "tokens")
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "tokens")))
    return sents.groupBy("docset_id", "doc_id").agg(F.flatten(F.transform(ordered, lambda x: x["tokens"])).alias("tokens"))
