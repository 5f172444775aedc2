"""Choosing sentences under a budget of tokens: lead, greedy without redundancy, and exact integer programming."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import split
from gistmill.functions import text as T
from gistmill.operators import docsets

#: Tokens that a sentence of a greedy summary has more than.
MIN_LENGTH = 7
#: Tokens that a sentence of an integer program has at least.
ILP_LENGTH = 25


def lead_k(sents: DataFrame, budget: int = 100) -> DataFrame:
    """docset_id, doc_id, sent_idx, n_tokens, running: of each docset's first document, from the first sentence that fits on,
    those up to the first that no longer does."""
    first = sents.withColumn("first", F.min("doc_id").over(Window.partitionBy("docset_id"))).where("doc_id = first")
    sized = first.select("docset_id", "doc_id", "sent_idx", F.size("tokens").alias("n_tokens"))
    started = sized.withColumn("start", F.min(F.when(F.col("n_tokens") <= budget, F.col("sent_idx"))).over(Window.partitionBy("docset_id"))).where("sent_idx >= start")
    return started.withColumn("running", F.sum("n_tokens").over(Window.partitionBy("docset_id").orderBy("sent_idx"))).where(F.col("running") <= budget).drop("start")


def lead(sizes: list[int], budget: int = 100) -> list[int]:
    """Which of a document's sentences lead_k() takes."""
    start = next((k for k, n in enumerate(sizes) if n <= budget), len(sizes))
    running, end = 0, start
    while end < len(sizes) and running + sizes[end] <= budget:
        running += sizes[end]
        end += 1
    return list(range(start, end))


def pick(ranked: Iterable[tuple[int, list[str]]], budget: int = 100, min_jaccard_dist: float | None = 0.7, rewrite=None) -> list[tuple[int, list[str], int]]:
    """Key, tokens and running tokens of the sentences that greedy() chooses of (key, tokens) by rank; reads no further than it must."""
    chosen, sets, used = [], [], 0
    for key, tokens in ranked:
        if re.match(T.UNFINISHED_QUOTE, " ".join(tokens)):
            continue
        toks = list(rewrite(list(tokens)) if rewrite else tokens)
        own = set(toks)
        if min_jaccard_dist is not None and any(1 - len(own & x) / len(own | x) <= min_jaccard_dist for x in sets if own | x):
            continue
        if len(toks) + used > budget:
            continue
        used += len(toks)
        sets.append(own)
        chosen.append((key, toks, used))
        if used >= budget:
            break
    return chosen


def greedy(ranked: DataFrame, budget: int = 100, topk: int | None = 25, min_jaccard_dist: float | None = 0.7, min_length: int | None = MIN_LENGTH, rewrite=None) -> DataFrame:
    """docset_id, order_idx, doc_id, sent_idx, tokens, running_tokens of the chosen sentences.

    ranked: docset_id, doc_id, sent_idx, rank, tokens. Sentences of min_length tokens or fewer, unfinished quotes and those
    not farther than min_jaccard_dist from any chosen one are passed over; so is one that doesn't fit, and the next is tried.
    rewrite: tokens -> tokens, applied to a sentence before it is judged. Only topk sentences of a docset reach its task; all
    do if topk is None.
    """
    long_enough = ranked if min_length is None else ranked.where(F.size("tokens") > min_length)
    top = long_enough if topk is None else long_enough.withColumn("place", F.row_number().over(Window.partitionBy("docset_id").orderBy("rank"))).where(F.col("place") <= topk)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        found = pick(rows.tokens.items(), budget, min_jaccard_dist, rewrite)
        chosen = [(rows.docset_id[k], n, rows.doc_id[k], rows.sent_idx[k], toks, used) for n, (k, toks, used) in enumerate(found)]
        return pd.DataFrame(chosen, columns=["docset_id", "order_idx", "doc_id", "sent_idx", "tokens", "running_tokens"])

    return top.groupBy("docset_id").applyInPandas(choose, "docset_id string, order_idx int, doc_id long, sent_idx int, tokens array<string>, running_tokens int")


def incidence(terms: DataFrame) -> DataFrame:
    """docset_id, doc_id, sent_idx, term: which concept (a term of a document) is in which sentence."""
    return terms.select("docset_id", "doc_id", "sent_idx", "term").distinct()


def concept_weights(incident: DataFrame, weighted: DataFrame) -> DataFrame:
    """docset_id, doc_id, term, w: a concept weighs as its term does in the docset."""
    return incident.select("docset_id", "doc_id", "term").distinct().join(weighted.select("docset_id", "term", "w"), ["docset_id", "term"])


def knapsack_cover(lengths: np.ndarray, covers: list[np.ndarray], weights: np.ndarray, budget: int, most_nodes: int = 20_000) -> tuple[list[int], float, bool]:
    """Sentences of the greatest sum of covered concepts' weights, the sum, and whether it is proven the greatest.

    Branch and bound over which sentence comes next by gain a token; the bound is the best way to fill what is left of the budget
    if sentences shared no concept, exact in the lengths. Concepts of no positive weight count only where they are covered, and
    lower the sum. A node is a sentence taken.
    """
    order = np.array([j for j in range(len(lengths)) if 0 < lengths[j] <= budget], int)
    if not len(order):
        return [], 0.0, True
    entry = np.concatenate([covers[j] for j in order]).astype(int)
    holder = np.repeat(np.arange(len(order)), [len(covers[j]) for j in order])
    by_concept = np.argsort(entry, kind="stable")
    holders, begin = holder[by_concept], np.searchsorted(entry[by_concept], np.arange(len(weights) + 1))
    sizes, useful = lengths[order].astype(int), np.maximum(weights, 0)
    signed = bool((weights < 0).any())

    def without(gain: np.ndarray, new: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The gains once these concepts are covered."""
        many = begin[new + 1] - begin[new]
        at = np.repeat(begin[new] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return gain - np.bincount(holders[at], np.repeat(of[new], many), len(order))

    def uncovered(k: int, covered: np.ndarray) -> np.ndarray:
        mine = covers[order[k]]
        return mine[~covered[mine]]

    gain, real = np.bincount(holder, useful[entry], len(order)), np.bincount(holder, weights[entry], len(order))
    # a greedy start
    covered, left, chosen, now = np.zeros(len(weights), bool), budget, [], real.copy()
    free = np.ones(len(order), bool)
    while True:
        ratio = np.where(free & (sizes <= left), now / sizes, -np.inf)
        k = int(ratio.argmax())
        if not ratio[k] > 1e-12:
            break
        new = uncovered(k, covered)
        covered[new], free[k] = True, False
        chosen.append(k)
        left -= sizes[k]
        now = without(now, new, weights)
    best, best_value, nodes = chosen, float(weights[covered].sum()), 0

    def search(at: np.ndarray, gain: np.ndarray, real: np.ndarray, covered: np.ndarray, left: int, value: float, taken: list[int]) -> bool:
        nonlocal best, best_value, nodes
        at = at[(sizes[at] <= left) & (gain[at] > 0)]
        if not len(at):
            return True
        if left < 2 * sizes[at].min():  # one more fits
            k = at[int(real[at].argmax())]
            if value + real[k] > best_value + 1e-12:
                best, best_value = [*taken, int(k)], value + float(real[k])
            return True
        at = at[np.argsort(-gain[at] / sizes[at], kind="stable")]
        fill = np.zeros((len(at) + 1, left + 1))  # the best sum of gains of at[k:] in a room
        for k in range(len(at) - 1, -1, -1):
            size = sizes[at[k]]
            fill[k] = fill[k + 1]
            np.maximum(fill[k, size:], fill[k + 1, : left + 1 - size] + gain[at[k]], out=fill[k, size:])
        for k, j in enumerate(at):
            if value + fill[k, left] <= best_value + 1e-9:
                break
            if value + gain[j] + fill[k + 1, left - sizes[j]] <= best_value + 1e-9:
                continue
            nodes += 1
            if nodes > most_nodes:
                return False
            new = uncovered(j, covered)
            then = value + float(weights[new].sum())
            if then > best_value + 1e-12:
                best, best_value = [*taken, int(j)], then
            more = covered.copy()
            more[new] = True
            less = without(gain, new, useful)
            less[less < 1e-15] = 0
            if not search(at[k + 1 :], less, without(real, new, weights) if signed else less, more, left - int(sizes[j]), then, [*taken, int(j)]):
                return False
        return True

    proven = search(np.arange(len(order)), gain, real if signed else gain, np.zeros(len(weights), bool), int(budget), 0.0, [])
    found = sorted(int(order[k]) for k in best)
    return found, float(weights[sorted({int(c) for j in found for c in covers[j]})].sum()) if found else 0.0, proven


def choose_cover(sizes: np.ndarray, s: np.ndarray, doc: np.ndarray, c: np.ndarray, w: np.ndarray, budget: int = 100, most_nodes: int = 20_000) -> tuple[list[int], float, bool]:
    """knapsack_cover() of a docset's sentences: sentence s, of document doc, has term c of weight w; a concept is a document's term."""
    held, place = np.unique(s, return_inverse=True)
    if not len(held):
        return [], 0.0, True
    key, concept = np.unique(doc * (int(c.max()) + 1) + c, return_inverse=True)
    weight = np.zeros(len(key))
    weight[concept] = w
    order = np.argsort(place, kind="stable")
    covers = np.split(concept[order], np.cumsum(np.bincount(place))[:-1])
    chosen, total, proven = knapsack_cover(sizes[held], covers, weight, budget, most_nodes)
    return held[chosen].tolist(), total, proven


def ilp_summary(docs: DataFrame, size: int | None = None, tokens: bool = False, budget: int = 100, min_length: int = ILP_LENGTH, most_nodes: int = 20_000) -> DataFrame:
    """docset_id, doc_id, sent_idx, objective, optimal of the documents' sentences that cover the concepts of the greatest weight, and
    their tokens if asked for; size: bytes of all texts, where they are known.

    A concept is a document's term and weighs as the term does in the docset. Sentences under min_length tokens take no part. A
    docset is one problem; optimal is false where most_nodes ended it.
    """

    def run(x: docsets.Docset) -> dict:
        sizes = np.array([len(split.tokens(s)) if len(s) >= min_length else 0 for s in x.raw])
        w = np.log(np.bincount(x.c, x.tf) + 0.01)[x.c] * x.idf if len(x.c) else np.zeros(0)
        kept = sizes[x.s] >= min_length
        chosen, total, proven = choose_cover(sizes, x.s[kept], np.unique(x.doc_id, return_inverse=True)[1][x.s[kept]], x.c[kept], w[kept], budget, most_nodes)
        out = {"doc_id": x.doc_id[chosen], "sent_idx": x.sent_idx[chosen], "objective": np.full(len(chosen), total), "optimal": np.full(len(chosen), proven)}
        return out | ({"tokens": [split.tokens(x.raw[k]) for k in chosen]} if tokens else {})

    schema = "docset_id string, doc_id long, sent_idx int, objective double, optimal boolean" + ", tokens array<string>" * tokens
    return docsets.over_docsets(docs, run, schema, raw=True, level="docset", size=size)


def ilp_summary_of_tables(sents: DataFrame, incident: DataFrame, concepts: DataFrame, budget: int = 100, min_length: int = ILP_LENGTH, most_nodes: int = 20_000) -> DataFrame:
    """ilp_summary() of sentences, incidence() and concept_weights() that lie in tables."""
    sized = sents.where(F.size("tokens") >= min_length).select("docset_id", "doc_id", "sent_idx", F.size("tokens").alias("n_tokens"))
    rows = sized.join(incident, ["docset_id", "doc_id", "sent_idx"]).join(concepts, ["docset_id", "doc_id", "term"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "sent_idx", "term"])
        keys = group[["doc_id", "sent_idx", "n_tokens"]].drop_duplicates().reset_index(drop=True)
        sentence = group.groupby(["doc_id", "sent_idx"], sort=True).ngroup().to_numpy()
        doc, term = (pd.factorize(group[x], sort=True)[0] for x in ("doc_id", "term"))
        chosen, total, proven = choose_cover(keys.n_tokens.to_numpy(), sentence, doc.astype(np.int64), term, group.w.to_numpy(float), budget, most_nodes)
        out = keys.loc[chosen, ["doc_id", "sent_idx"]].copy()
        out.insert(0, "docset_id", group.docset_id.iloc[0])
        out["objective"], out["optimal"] = total, proven
        return out

    return rows.groupBy("docset_id").applyInPandas(solve, "docset_id string, doc_id long, sent_idx int, objective double, optimal boolean")


def trim_summary(sents: DataFrame, budget: int) -> DataFrame:
    """Sentences (docset_id, order_idx, tokens) without the last ones beyond the budget."""
    running = F.sum(F.size("tokens")).over(Window.partitionBy("docset_id").orderBy("order_idx"))
    return sents.withColumn("running", running).where(F.col("running") <= budget).drop("running")
