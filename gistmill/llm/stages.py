"""Stages of the corpus pipeline: (name, function of spark, docs, sf_dir).

Each works on all rows that the one before kept. All but the last return the columns of documents, in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, jaccard, pii, quality
from .common import bound_batches, returning, ship, text_bytes
from .queries import PATTERN, VOCABULARY, table

#: Documents of a lower quality score go.
LEAST_QUALITY = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under distinct column names, and these by the first of each old name: clashing names do no harm."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), {name: f"c{i}" for i, name in reversed(list(enumerate(names)))}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on the labels, doesn't reject. Null and empty texts are judged like
    others; repeated rows each are; an empty table stays empty."""
    bound_batches(spark)
    plain, at = _plain(docs)
    trees = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return plain.where(quality.score_column(spark, trees, text_bytes(at["text"])) >= LEAST_QUALITY).toDF(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id. Documents without shingles or without an id all
    stay; rows of one id are one document and stay or go together; an empty table stays empty."""
    bound_batches(spark)
    plain, at = _plain(docs)
    gone = jaccard.link(docs, links_too=False).where("component_id <> doc_id").select(F.col("doc_id").alias(at["doc_id"])).distinct()
    return plain.join(gone, at["doc_id"], "left_anti").select(*plain.columns).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item or an edited copy of one. Null and empty texts stay; an empty table stays empty."""
    bound_batches(spark)
    plain, at = _plain(docs)
    leak = decontamination.leak_score(plain, table(spark, sf_dir, "benchmark"), at["text"])
    return plain.where(leak < decontamination.LEAST_SCORE).toDF(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind, and n_chars of the new text where the column is.
    Null texts stay null; repeated rows stay; an empty table stays empty."""
    bound_batches(spark)
    ship(spark)
    plain, at = _plain(docs)

    @F.arrow_udf("string")
    @returning
    def redacted(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield pa.array((pii.redact(x, pii.find(x)) for x in texts.to_pylist()), pa.string(), size=len(texts))

    out = plain.withColumn(at["text"], redacted(at["text"]))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return out.toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, of every document; a null text is empty. Repeated rows
    and null ids each give a row, texts of any length are encoded whole, an empty table gives none; other columns, even of
    clashing names, do no harm."""
    bound_batches(spark)
    return bpe.encode(docs, VOCABULARY, PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("tokens", encode),
]
