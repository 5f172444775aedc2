"""ROUGE-1 and ROUGE-2 as joins of n-gram counts, on words or stems, of whole texts or their first words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gistmill.functions import split
from gistmill.functions import text as T
from gistmill.functions.stem import porter
from gistmill.operators.docsets import Docset, Group
from gistmill.operators.similarity import BLOCK


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Porter's stem of each word of an array."""
    return words.map(lambda x: [porter(w) for w in x])


def gram_counts(texts: DataFrame, keys: list[str], n: int, stem: bool = False, limit: int | None = None) -> DataFrame:
    """keys, gram, c, total of lower-cased word n-grams of the column tokens; a text without any has no rows. Words beyond
    the first `limit` do not count."""
    words = T.words(F.coalesce("tokens", F.array().cast("array<string>")), entities=False)
    words = words if limit is None else F.slice(words, 1, limit)
    grams = texts.select(*keys, F.explode(T.ngrams(stems(words) if stem else words, n, padded=False)).alias("gram"))
    counts = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("total", F.sum("c").over(Window.partitionBy(*keys)))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def scores(summaries: DataFrame, references: DataFrame, on: list[str], summary: list[str], reference: list[str], n: int = 1, stem: bool = False, limit: int | None = None) -> DataFrame:
    """on, summary, reference, p, r, f of every summary and reference of one `on`; pairs without a shared n-gram score 0."""
    a, b = gram_counts(summaries, [*on, *summary], n, stem, limit), gram_counts(references, [*on, *reference], n, stem, limit)
    met = a.select(*on, *summary, "gram", F.col("c").alias("ca"), F.col("total").alias("na")).join(b.select(*on, *reference, "gram", F.col("c").alias("cb"), F.col("total").alias("nb")), [*on, "gram"])
    shared = met.groupBy(*on, *summary, *reference).agg(F.sum(F.least("ca", "cb")).alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = summaries.select(*on, *summary).join(references.select(*on, *reference), on)
    met = pairs.join(shared, [*on, *summary, *reference], "left")
    ratio = lambda total: F.coalesce(F.col("shared") / F.col(total), F.lit(0.0))
    return met.select(*on, *summary, *reference, ratio("na").alias("p"), ratio("nb").alias("r")).withColumn("f", f_score(F.col("p"), F.col("r")))


def leave_one_out(sents: DataFrame, n: int = 1) -> DataFrame:
    """docset_id, doc_id, sent_idx, p, r, f of each sentence against the rest of its document, whose counts are the
    document's less its own. N-grams do not run over sentence ends."""
    keys = ["docset_id", "doc_id", "sent_idx"]
    doc = ["docset_id", "doc_id"]
    own = gram_counts(sents.repartition(*doc), keys, n)  # a document's sentences stay together from here on
    counted = own.withColumns({"doc_c": F.sum("c").over(Window.partitionBy(*doc, "gram")), "doc_total": F.sum("c").over(Window.partitionBy(*doc))})
    least = F.least(F.col("c"), F.col("doc_c") - F.col("c"))
    shared = counted.groupBy(*keys).agg(F.sum(least).alias("shared"), F.max("total").alias("total"), F.max("doc_total").alias("doc_total"))
    met = sents.select(*keys).join(shared, keys, "left")
    rest = F.col("doc_total") - F.col("total")
    p = F.coalesce(F.col("shared") / F.col("total"), F.lit(0.0))
    r = F.when(rest > 0, F.col("shared") / rest).otherwise(0.0)
    return met.select(*keys, p.alias("p"), r.alias("r")).withColumn("f", f_score(F.col("p"), F.col("r")))


def plain_counts(tokens: list[str], n: int, stem: bool = False, limit: int | None = None) -> Counter:
    """gram_counts() of one text."""
    words = [split.lower(x) for x in tokens if split.is_word(x)][:limit]
    words = [porter(x) for x in words] if stem else words
    return Counter(zip(*(words[k:] for k in range(n)), strict=False))


def plain_scores(own: Counter, other: Counter) -> tuple[float, float, float]:
    """p, r, f of one text's counts against another's."""
    shared = sum(min(c, other[gram]) for gram, c in own.items() if gram in other)
    p, r = (shared / x.total() if shared else 0.0 for x in (own, other))
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def rest_scores(x: Group, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leave_one_out() of a few documents."""
    sentence, gram, _ = x.grams(n, False)
    s, g, c = x.counts(sentence, gram)
    row, many = x.row[s].astype(np.int64), int(gram.max(initial=0)) + 1
    _, place = np.unique(row * many + g, return_inverse=True)
    of_doc = np.bincount(place, c)[place]
    shared, total = (np.bincount(s, v, len(x.doc_id)) for v in (np.minimum(c, of_doc - c), c))
    rest = np.bincount(x.row, total, len(x.ids))[x.row] - total
    p, r = _ratio(shared, total), np.where(total > 0, _ratio(shared, rest), 0.0)
    return p, r, _ratio(2 * p * r, p + r)


def mean_scores(x: Docset, golds: np.ndarray) -> np.ndarray:
    """The mean f of each sentence's words against those of the sentences golds. Only pairs that share a word are met, block by block."""
    total = np.bincount(x.s, x.tf, x.n)
    number = np.full(x.n, -1)
    number[golds] = np.arange(len(golds))
    mine = number[x.s] >= 0
    order = np.argsort(x.c[mine], kind="stable")
    gold, held, tf = number[x.s[mine]][order], x.c[mine][order], x.tf[mine][order]
    begin, end = np.searchsorted(held, x.c), np.searchsorted(held, x.c, "right")
    until = np.searchsorted(x.s, np.arange(x.n + 1))
    out, a, work = np.zeros(x.n), 0, np.append(0, np.cumsum(end - begin))[until]
    while a < x.n:
        b = max(a + 1, min(int(np.searchsorted(work, work[a] + BLOCK, "right")) - 1, a + BLOCK // max(len(golds), 1)))
        own = slice(until[a], until[b])
        many = end[own] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(np.repeat((x.s[own] - a) * len(golds), many) + gold[at], np.minimum(np.repeat(x.tf[own], many), tf[at]), (b - a) * len(golds)).reshape(b - a, len(golds))
        both = total[a:b, None] + total[golds]
        out[a:b] = np.divide(2.0 * shared, both, out=np.zeros_like(shared), where=both > 0).sum(1) / max(len(golds), 1)
        a = b
    return out


@F.pandas_udf(StringType())
def fixed5(x: pd.Series) -> pd.Series:
    """Five decimals as C's printf gives them: of the number as it is stored, not of its shortest decimal."""
    return x.map(lambda v: f"{v:6.5f}", na_action="ignore")


def averages(table: DataFrame) -> DataFrame:
    """method, rouge, p, r, f."""
    return table.groupBy("method", "rouge").agg(*[F.avg(x).alias(x) for x in "prf"])


def report_lines(table: DataFrame) -> DataFrame:
    """method, rouge, line: the averages' and each row's line of a score report."""
    name = F.upper("rouge")
    rows = table.select("method", "rouge", "file", F.format_string("%s %s Eval %s R:%s P:%s F:%s", "method", name, "file", *[fixed5(x) for x in "rpf"]).alias("line"))
    mean = averages(table).select("method", "rouge", F.explode(F.array(*[F.struct(F.lit(f"Average_{x.upper()}").alias("file"), F.format_string(f"%s %s Average_{x.upper()} %s", "method", name, fixed5(x)).alias("line")) for x in "prf"])).alias("s"))
    return rows.unionByName(mean.select("method", "rouge", "s.file", "s.line")).select("method", "rouge", "file", "line")


def same_ids(summaries: DataFrame, references: DataFrame, key: str = "base_id") -> int:
    """How many ids only one side has; an evaluation wants 0."""
    a, b = summaries.select(key).distinct().withColumn("a", F.lit(1)), references.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").where("a is null or b is null").count()
