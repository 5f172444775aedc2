"""Term counts and TF-IDF weights at sentence or docset level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import text as T

UNITS = {"sentence": ["docset_id", "doc_id", "sent_idx"], "document": ["docset_id", "doc_id"], "docset": ["docset_id"]}


def check(ngram: int, level: str) -> None:
    if ngram not in (1, 2, 3):
        raise ValueError("ngram is 1, 2 or 3")
    if level not in UNITS:
        raise ValueError(f"level is one of {', '.join(UNITS)}")


def tf(terms: DataFrame, level: str) -> DataFrame:
    return terms.groupBy(*UNITS[level], "term").agg(F.count(F.lit(1)).alias("tf"))


def df(tf_table: DataFrame) -> DataFrame:
    """df (units that hold a term) and cf (all its occurrences)."""
    return tf_table.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Counts (term, n) added up."""
    return reduce(DataFrame.unionByName, tables).groupBy("term").agg(F.sum("n").alias("n"))


def idf(tf_table: DataFrame, level: str, formula: str = "documented", delta: float = 0.7) -> DataFrame:
    """term, df, cf, idf. Formulas: documented, ratio, collection (counts all occurrences), constant (one unit in all)."""
    units = tf_table.select(*UNITS[level]).distinct().agg(F.count(F.lit(1)).cast("double").alias("units"))
    return idf_of(df(tf_table), units, formula, delta)


def idf_of(counts: DataFrame, units: DataFrame, formula: str = "documented", delta: float = 0.7) -> DataFrame:
    """idf() of counts (term, df, cf) and a row with the number of units."""
    counted = counts.join(F.broadcast(units))  # one row
    by = {
        "documented": T.idf_documented(F.col("units"), F.col("df"), delta),
        "ratio": T.idf_ratio(F.col("units"), F.col("df"), delta),
        "collection": T.idf_documented(F.col("units"), F.col("cf"), delta),
        "constant": T.idf_ratio(F.lit(1.0), F.lit(1.0), delta),
    }
    if formula not in by:
        raise ValueError(f"formula is one of {', '.join(by)}")
    return counted.select("term", "df", "cf", by[formula].alias("idf"))


def weights(tf_table: DataFrame, idf_table: DataFrame, tf_delta: float = 0.01, idf_delta: float = 0.7, log_tf: bool = True) -> DataFrame:
    """w of each unit's terms; a term without idf has the one of a term never seen."""
    unseen = F.log(F.lit(idf_delta)) + idf_delta
    met = tf_table.join(idf_table.select("term", "idf"), "term", "left")
    return met.withColumn("w", T.tf_weight(F.col("tf"), tf_delta, log_tf) * F.coalesce("idf", unseen))


def unseen_weight(tf_delta: float = 0.01, idf_delta: float = 0.7) -> float:
    """The weight of a term that neither table has seen; negative at the usual deltas."""
    from math import log

    return log(tf_delta) * (log(idf_delta) + idf_delta)


def sentence_vectors(terms: DataFrame, idf_table: DataFrame) -> DataFrame:
    """Sparse vectors of sentences: log(1 + tf) * idf; terms outside the vocabulary are left out."""
    counted = tf(terms, "sentence").join(idf_table.select("term", "idf"), "term")
    return counted.select(*UNITS["sentence"], "term", (F.log1p("tf") * F.col("idf")).alias("w"))
