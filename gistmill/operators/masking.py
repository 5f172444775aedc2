"""Gap-sentence and reordering datasets for summarizers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import split


def _doc():
    return Window.partitionBy("docset_id", "doc_id")


def gap_flags(scored: DataFrame, mode: str = "documented") -> DataFrame:
    """masked and thrown of each sentence (docset_id, doc_id, sent_idx, f).

    Documented: the top 30 % are masked, the lowest 30 % thrown. as_implemented: the lowest 20 % are masked and the lowest
    30 % thrown, a mask first. Shares are rounded down, ties go by place.
    """
    n = F.count(F.lit(1)).over(_doc())
    low = F.row_number().over(_doc().orderBy(F.round("f", 9), "sent_idx"))
    high = F.row_number().over(_doc().orderBy(F.round("f", 9).desc(), "sent_idx"))
    numbered = scored.select("docset_id", "doc_id", "sent_idx", "f", n.alias("n"), low.alias("low"), high.alias("high"))
    if mode == "documented":
        masked = F.col("high") <= F.floor(F.col("n") * 3 / 10)
    elif mode == "as_implemented":
        masked = F.col("low") <= F.floor(F.col("n") * 2 / 10)
    else:
        raise ValueError("mode is documented or as_implemented")
    thrown = ~masked & (F.col("low") <= F.floor(F.col("n") * 3 / 10))
    return numbered.select("docset_id", "doc_id", "sent_idx", "f", masked.alias("masked"), thrown.alias("thrown"))


def plain_flags(f: np.ndarray, mode: str = "documented") -> tuple[np.ndarray, np.ndarray]:
    """gap_flags() of one document's scores."""
    n, f = len(f), np.floor(np.asarray(f) * 1e9 + 0.5)
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    low[np.argsort(f, kind="stable")] = high[np.argsort(-f, kind="stable")] = np.arange(1, n + 1)
    masked = high <= n * 3 // 10 if mode == "documented" else low <= n * 2 // 10
    return masked, ~masked & (low <= n * 3 // 10)


def plain_pieces(masked: np.ndarray, thrown: np.ndarray, sentences, most_tokens: int = 1024) -> list[tuple[int, str, int]]:
    """sent_idx, piece and running tokens of gap_pieces() of one document; sentences: pyarrow strings, read no further than needed."""
    out, running, before = [], 0, False
    for k in np.flatnonzero(~thrown).tolist():
        if masked[k] and before:
            continue
        before = bool(masked[k])
        piece = "[MASK]" if before else sentences[k].as_py()
        running += 1 if before else len(split.tokens(piece))
        if running > most_tokens:
            break
        out.append((k, piece, running))
    return out


def gap_pieces(flags: DataFrame, sents: DataFrame, merge_masks: bool = True, most_tokens: int = 1024) -> DataFrame:
    """docset_id, doc_id, sent_idx, piece, running of what stays of each document up to its first piece beyond the limit.

    A mask is one token; of masks in a row (thrown sentences between them don't count) one stays.
    """
    kept = flags.where("not thrown").join(sents.select("docset_id", "doc_id", "sent_idx", "sentence", F.size("tokens").alias("n_tokens")), ["docset_id", "doc_id", "sent_idx"])
    before = F.lag("masked").over(_doc().orderBy("sent_idx"))
    if merge_masks:
        kept = kept.withColumn("before", before).where("not (masked and coalesce(before, false))")
    piece = F.when(F.col("masked"), F.lit("[MASK]")).otherwise(F.col("sentence"))
    cost = F.when(F.col("masked"), F.lit(1)).otherwise(F.col("n_tokens"))
    running = kept.select("docset_id", "doc_id", "sent_idx", piece.alias("piece"), F.sum(cost).over(_doc().orderBy("sent_idx")).alias("running"))
    return running.where(F.col("running") <= most_tokens)


def gap_dataset(pieces: DataFrame) -> DataFrame:
    """docset_id, doc_id, text: the pieces in order, joined by blanks."""
    packed = F.array_sort(F.collect_list(F.struct("sent_idx", "piece")))
    return pieces.groupBy("docset_id", "doc_id").agg(F.array_join(F.transform(packed, lambda x: x["piece"]), " ").alias("text"))


def summaries_of(rows: DataFrame, seed: int | None = None) -> DataFrame:
    """A row for each gold summary (array column summary); with a seed, one chosen by hash for each id."""
    each = rows.select("id", "text", F.explode("summary").alias("summary"))
    if seed is None:
        return each
    return each.groupBy("id", "text").agg(F.min_by("summary", F.struct(F.xxhash64("id", "summary", F.lit(seed)), "summary")).alias("summary"))


def shuffle_key(seed: int, *cols: str) -> Column:
    """A hash that orders rows the same way in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def permuted(sents: DataFrame, seed: int = 43, most: int = 800) -> DataFrame:
    """docset_id, doc_id, sent_idx, new_idx, sentence: the sentences of each document's start (3 + tokens + 1 each, under
    `most`) in a shuffled order."""
    running = 3 + F.sum(F.size("tokens") + 1).over(_doc().orderBy("sent_idx"))
    start = sents.withColumn("running", running).where(F.col("running") < most)
    keyed = start.withColumn("k", shuffle_key(seed, "doc_id", "sent_idx"))
    return keyed.select("docset_id", "doc_id", "sent_idx", (F.row_number().over(_doc().orderBy("k", "sent_idx")) - 1).alias("new_idx"), "sentence")


def reorder_prompts(shuffled: DataFrame) -> DataFrame:
    """docset_id, doc_id, input, target: '[shuffled] <S0> ... [orig]' and the sentences' former places."""
    packed = F.array_sort(F.collect_list(F.struct("new_idx", "sent_idx", "sentence")))
    lines = F.array_join(F.transform("p", lambda x: F.concat(F.lit("<S"), x["new_idx"].cast("string"), F.lit("> "), x["sentence"])), " ")
    target = F.array_join(F.transform("p", lambda x: x["sent_idx"].cast("string")), " ")
    return shuffled.groupBy("docset_id", "doc_id").agg(packed.alias("p")).select("docset_id", "doc_id", F.concat(F.lit("[shuffled] "), lines, F.lit(" [orig]")).alias("input"), F.concat(target, F.lit(" <eos>")).alias("target"))


def perplexity(losses: DataFrame) -> DataFrame:
    """macro (exp of the mean loss a token of batches) and micro (exp of all loss over all tokens)."""
    return losses.agg(F.exp(F.avg(F.col("loss") / F.col("n_tokens"))).alias("macro"), F.exp(F.sum("loss") / F.sum("n_tokens")).alias("micro"))
