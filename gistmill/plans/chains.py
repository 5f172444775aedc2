"""Queries over ROUGE, gap-sentence datasets and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gistmill.functions import split
from gistmill.functions import text as T
from gistmill.operators import docsets, masking, realization, rouge, selection
from gistmill.plans.registry import query, quoted
from gistmill.plans.texts import by_document, docs, lead_sents, read, sents, whole
from gistmill.sources import files

_WORDS = r"list_transform(list_filter(tokens, lambda x: regexp_matches(x, '[\p{L}\p{N}_]') and not starts_with(x, '&')), lambda x: lower(x))"


def _grams(table: str, keys: str, n: int) -> str:
    gram = "w[i]" if n == 1 else "w[i] || ' ' || w[i + 1]"
    return f"select {keys}, gram, count(*) as c, cast(sum(count(*)) over (partition by {keys}) as bigint) as total from (select {keys}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) as gram from (select {keys}, {_WORDS} as w from {table}) where len(w) >= {n}) group by {keys}, gram"


#: Summaries: the first document's lead. References: each document's first sentence.
_LEAD = """firsts as (select *, len(tokens) as n_tokens from sents where doc_id in (select min(doc_id) from sents group by docset_id)),
    begun as (select * from firsts f where sent_idx >= (select min(sent_idx) from firsts g where g.docset_id = f.docset_id and g.n_tokens <= 100)),
    run as (select docset_id, sent_idx, tokens, sum(n_tokens) over (partition by docset_id order by sent_idx) as running from begun),
    lead as (select docset_id, 'lead' as method, flatten(list(tokens order by sent_idx)) as tokens from run where running <= 100 group by docset_id union all select docset_id, 'longest', arg_max(tokens, struct_pack(a := len(tokens), b := -doc_id, c := -sent_idx)) from sents group by docset_id),
    refs as (select docset_id, doc_id, tokens from sents where sent_idx = 0)"""


def briefs(spark, sf_dir):
    """docset_id, doc_id and of each document with a sentence the tokens of its first one (first), of its longest (longest) and of
    its lead (lead). One pass over documents."""

    def run(x: docsets.Group) -> pa.Table:
        out = {"first": [], "longest": [], "lead": []}
        for a, b in zip(x.doc_begins, x.doc_ends, strict=True):
            tokens = [split.tokens(s) for s in x.raws[int(a) : int(b)].to_pylist()]
            out["first"].append(tokens[0])
            out["longest"].append(max(tokens, key=len))
            out["lead"].append([t for k in selection.lead([len(t) for t in tokens]) for t in tokens[k]])
        arrays = {k: pa.array(v, pa.list_(pa.string())) for k, v in out.items()}
        return pa.table({"docset_id": x.ids, "doc_id": x.doc_id[x.doc_begins], **arrays})

    return by_document(spark, sf_dir, run, "docset_id string, doc_id long, first array<string>, longest array<string>, lead array<string>", raw=True)


def scores(spark, sf_dir, n, **how):
    """rouge.scores() of the lead of a docset's first document and of its longest sentence against each document's first sentence."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("doc_id").to_pylist()
        longest = max(rows, key=lambda r: len(r["longest"]))["longest"]
        methods = [("lead", rows[0]["lead"])] * bool(rows[0]["lead"]) + [("longest", longest)]
        golds = [rouge.plain_counts(r["first"], n, **how) for r in rows]
        out = [(rows[0]["docset_id"], method, r["doc_id"], *rouge.plain_scores(own, gold)) for method, own in [(m, rouge.plain_counts(t, n, **how)) for m, t in methods] for r, gold in zip(rows, golds, strict=True)]
        return pa.table(dict(zip(("docset_id", "method", "doc_id", "p", "r", "f"), map(list, zip(*out, strict=True)), strict=True)))

    return briefs(spark, sf_dir).groupBy("docset_id").applyInArrow(run, "docset_id string, method string, doc_id long, p double, r double, f double")


def _score_sql(n: int) -> str:
    return f"""{_LEAD}, a as ({_grams("lead", "docset_id, method", n)}), b as ({_grams("refs", "docset_id, doc_id", n)}),
    shared as (select a.docset_id, method, doc_id, sum(least(a.c, b.c)) as shared from a join b on a.docset_id = b.docset_id and a.gram = b.gram group by all),
    na as (select distinct docset_id, method, total as na from a), nb as (select distinct docset_id, doc_id, total as nb from b),
    pr as (select docset_id, method, doc_id, case when na > 0 then coalesce(shared, 0) / cast(na as double) else 0.0 end as p, case when nb > 0 then coalesce(shared, 0) / cast(nb as double) else 0.0 end as r from lead join refs using (docset_id) left join shared using (docset_id, method, doc_id) left join na using (docset_id, method) left join nb using (docset_id, doc_id)),
    scored{n} as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from pr)"""


for _n in (1, 2):

    @query(f"rouge{_n}", f"with {_score_sql(_n)} select docset_id, method, doc_id, round(p, 6) + 0.0 as p, round(r, 6) + 0.0 as r, round(f, 6) + 0.0 as f from scored{_n}")
    def _(spark, sf_dir, n=_n):
        return scores(spark, sf_dir, n)


#: Words of a text that count where scores are limited.
WORD_LIMIT = 100


@query("rouge1_limited", f"with {_score_sql(1)} select docset_id, method, doc_id, round(p, 6) + 0.0 as p, round(r, 6) + 0.0 as r, round(f, 6) + 0.0 as f from scored1".replace(f"{_WORDS} as w", f"({_WORDS})[1:{WORD_LIMIT}] as w"))
def _(spark, sf_dir):
    return scores(spark, sf_dir, 1, limit=WORD_LIMIT)


for _n in (1, 2):

    @query(f"rouge{_n}_stemmed")
    def _(spark, sf_dir, n=_n):
        return scores(spark, sf_dir, n, stem=True, limit=WORD_LIMIT)


@query("summary_sentence_match", f"with {_LEAD}, bags as (select docset_id, list_sort(list_distinct(tokens)) as bag, min(struct_pack(d := doc_id, s := sent_idx)) as place from sents group by all) select docset_id, r.sent_idx as order_idx, place.d as doc_id, place.s as sent_idx from (select docset_id, sent_idx, list_sort(list_distinct(tokens)) as bag from run where running <= 100) r join bags using (docset_id, bag)")
def _(spark, sf_dir):
    first = lead_sents(spark, sf_dir)
    lead = selection.lead_k(first).join(first.select("doc_id", "sent_idx", "tokens"), ["doc_id", "sent_idx"])
    return realization.match_sentences(lead.select("docset_id", F.col("sent_idx").alias("order_idx"), "tokens"), sents(spark, sf_dir))


@query("rouge_best_reference", f"with {_score_sql(1)} select docset_id, method, arg_max(doc_id, struct_pack(a := round(f, 9), b := -doc_id)) as doc_id, round(max(f), 6) + 0.0 as f from scored1 group by docset_id, method")
def _(spark, sf_dir):
    best = F.struct(F.round("f", 9).alias("a"), (-F.col("doc_id")).alias("b"))
    return scores(spark, sf_dir, 1).groupBy("docset_id", "method").agg(F.max_by("doc_id", best).alias("doc_id"), F.max("f").alias("f"))


@query("rouge_avg_by_method", f"with {_score_sql(1)} select method, 'rouge-1' as rouge, round(avg(p), 6) + 0.0 as p, round(avg(r), 6) + 0.0 as r, round(avg(f), 6) + 0.0 as f from scored1 group by method")
def _(spark, sf_dir):
    return rouge.averages(scores(spark, sf_dir, 1).withColumn("rouge", F.lit("rouge-1")))


@query("rouge_report", f"with {_score_sql(1)} select method, 'rouge-1' as rouge, docset_id || '.' || doc_id as file, printf('%s ROUGE-1 Eval %s R:%6.5f P:%6.5f F:%6.5f', method, docset_id || '.' || doc_id, r, p, f) as line from scored1")
def _(spark, sf_dir):
    table = scores(spark, sf_dir, 1).select("method", F.lit("rouge-1").alias("rouge"), F.concat_ws(".", "docset_id", "doc_id").alias("file"), "p", "r", "f")
    return rouge.report_lines(table).where(~F.col("file").startswith("Average_"))


@query("rouge_report_averages", f"with {_score_sql(1)}, m as (select method, avg(p) as p, avg(r) as r, avg(f) as f from scored1 group by method) select method, 'rouge-1' as rouge, 'Average_' || x as file, printf('%s ROUGE-1 Average_%s %6.5f', method, x, v) as line from (select method, unnest(['P', 'R', 'F']) as x, unnest([p, r, f]) as v from m)")
def _(spark, sf_dir):
    table = scores(spark, sf_dir, 1).select("method", F.lit("rouge-1").alias("rouge"), F.concat_ws(".", "docset_id", "doc_id").alias("file"), "p", "r", "f")
    return rouge.report_lines(table).where(F.col("file").startswith("Average_"))


def _rejoined_sql(patterns) -> str:
    out = "array_to_string(tokens, ' ')"
    for pattern, by in patterns:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    return out


#: Tokens of sentences by the library's contract, put between quotes that both rules know.
_MARKED = "select doc_id, sent_idx, list_concat(['``', '\"'], tokens, ['is', 'n''t', '\"', '''s', '''''']) as tokens from sents"


@query("detokenized", f"select doc_id, sent_idx, {_rejoined_sql(T.TREEBANK)} as treebank, {_rejoined_sql(T.MOSES)} as moses from ({_MARKED})")
def _(spark, sf_dir):
    around = lambda *x: F.array(*map(F.lit, x))
    marked = sents(spark, sf_dir).select("doc_id", "sent_idx", F.concat(around("``", '"'), "tokens", around("is", "n't", '"', "'s", "''")).alias("tokens"))
    return marked.select("doc_id", "sent_idx", T.detokenizer("treebank")(F.col("tokens")).alias("treebank"), T.detokenizer("moses")(F.col("tokens")).alias("moses"))


def _loo_sql(n: int) -> str:
    return f"""own as materialized ({_grams("sents", "docset_id, doc_id, sent_idx", n)}), whole as (select doc_id, gram, sum(c) as doc_c from own group by all), tot as (select distinct doc_id, sent_idx, total from own), size as (select doc_id, sum(total) as doc_total from tot group by doc_id),
    sh as (select doc_id, sent_idx, sum(least(c, doc_c - c)) as shared from own join whole using (doc_id, gram) group by all),
    pr as (select s.docset_id, s.doc_id, s.sent_idx, case when total > 0 then shared / cast(total as double) else 0.0 end as p, case when doc_total - total > 0 then coalesce(shared, 0) / cast(doc_total - total as double) else 0.0 end as r from sents s left join tot using (doc_id, sent_idx) left join size using (doc_id) left join sh using (doc_id, sent_idx)),
    loo as materialized (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from pr)"""


for _n in (1, 2):

    @query(f"rouge{_n}_loo", f"with {_loo_sql(_n)} select doc_id, sent_idx, round(p, 6) + 0.0 as p, round(r, 6) + 0.0 as r, round(f, 6) + 0.0 as f from loo")
    def _(spark, sf_dir, n=_n):
        def run(x: docsets.Group) -> pa.Table:
            p, r, f = rouge.rest_scores(x, n)
            return pa.table({"doc_id": x.doc_id, "sent_idx": x.sent_idx, "p": p, "r": r, "f": f})

        return by_document(spark, sf_dir, run, "doc_id long, sent_idx int, p double, r double, f double", without=docsets.PLAIN)


@query(
    "rouge_gold_mean",
    f"with refs as (select docset_id, doc_id as gold, tokens from sents where sent_idx = 0), a as ({_grams('sents', 'docset_id, doc_id, sent_idx', 1)}), b as ({_grams('refs', 'docset_id, gold', 1)}), sh as (select a.docset_id, doc_id, sent_idx, gold, sum(least(a.c, b.c)) as shared, any_value(a.total) as na, any_value(b.total) as nb from a join b on a.docset_id = b.docset_id and a.gram = b.gram group by all), golds as (select docset_id, count(*) as golds from refs group by docset_id) select s.doc_id, s.sent_idx, round(coalesce(sum(2.0 * shared / (na + nb)), 0) / any_value(golds), 6) + 0.0 as f from sents s join golds using (docset_id) left join sh using (docset_id, doc_id, sent_idx) group by s.doc_id, s.sent_idx",
)
def _(spark, sf_dir):
    def run(x: docsets.Docset) -> dict:
        return {"doc_id": x.doc_id, "sent_idx": x.sent_idx, "f": rouge.mean_scores(x, np.flatnonzero(x.sent_idx == 0))}

    return whole(docsets.over_docsets, spark, sf_dir, run, "docset_id string, doc_id long, sent_idx int, f double", without=docsets.PLAIN, level=None).drop("docset_id")


def _flags_sql(mode: str) -> str:
    masked = "high <= n * 3 // 10" if mode == "documented" else "low <= n * 2 // 10"
    return f"""{_loo_sql(1)}, num as (select docset_id, doc_id, sent_idx, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by round(f, 9), sent_idx) as low, row_number() over (partition by doc_id order by round(f, 9) desc, sent_idx) as high from loo),
    flags as (select docset_id, doc_id, sent_idx, {masked} as masked, not ({masked}) and low <= n * 3 // 10 as thrown from num)"""


def flagged(x: docsets.Group, mode: str = "documented"):
    """masked and thrown of a few documents' sentences."""
    f, masked, thrown = rouge.rest_scores(x, 1)[2], np.zeros(len(x.doc_id), bool), np.zeros(len(x.doc_id), bool)
    for a, b in zip(x.doc_begins, x.doc_ends, strict=True):
        masked[a:b], thrown[a:b] = masking.plain_flags(f[a:b], mode)
    return masked, thrown


for _mode in ("documented", "as_implemented"):

    @query(f"gap_flags_{_mode}", f"with {_flags_sql(_mode)} select doc_id, sent_idx, masked, thrown from flags")
    def _(spark, sf_dir, mode=_mode):
        def run(x: docsets.Group) -> pa.Table:
            masked, thrown = flagged(x, mode)
            return pa.table({"doc_id": x.doc_id, "sent_idx": x.sent_idx, "masked": masked, "thrown": thrown})

        return by_document(spark, sf_dir, run, "doc_id long, sent_idx int, masked boolean, thrown boolean", without=docsets.PLAIN)


_PIECES = f"""{_flags_sql("documented")}, k as (select f.*, s.sentence, len(s.tokens) as n_tokens, lag(masked) over (partition by doc_id order by sent_idx) as before from flags f join sents s using (docset_id, doc_id, sent_idx) where not thrown),
    run as (select doc_id, sent_idx, case when masked then '[MASK]' else sentence end as piece, cast(sum(case when masked then 1 else n_tokens end) over (partition by doc_id order by sent_idx) as bigint) as running from k where not (masked and coalesce(before, false)))"""


def pieces(x: docsets.Group):
    """doc_id, and its pieces (sent_idx, piece, running), of a few documents."""
    masked, thrown = flagged(x)
    for a, b in zip(x.doc_begins, x.doc_ends, strict=True):
        yield int(x.doc_id[a]), masking.plain_pieces(masked[a:b], thrown[a:b], x.raws[int(a) : int(b)])


@query("gap_truncate", f"with {_PIECES} select doc_id, sent_idx, piece, running from run where running <= 1024")
def _(spark, sf_dir):
    def run(x: docsets.Group) -> pa.Table:
        rows = [(doc, *r) for doc, found in pieces(x) for r in found]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["doc_id", "sent_idx", "piece", "running"])

    return by_document(spark, sf_dir, run, "doc_id long, sent_idx int, piece string, running long", raw=True, without=docsets.PLAIN)


@query("gap_dataset", f"with {_PIECES} select doc_id, string_agg(piece, ' ' order by sent_idx) as text from run where running <= 1024 group by doc_id")
def _(spark, sf_dir):
    def run(x: docsets.Group) -> pa.Table:
        rows = [(doc, " ".join(piece for _, piece, _ in found)) for doc, found in pieces(x) if found]
        return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})

    return by_document(spark, sf_dir, run, "doc_id long, text string", raw=True, without=docsets.PLAIN)


_SHUFFLED = "st as (select *, 3 + sum(len(tokens) + 1) over (partition by doc_id order by sent_idx) as running from sents), sh as (select docset_id, doc_id, sent_idx, row_number() over (partition by doc_id order by md5(doc_id || '|' || sent_idx || '|43'), sent_idx) - 1 as new_idx, sentence from st where running < 800)"


@query("shuffled_permutation", f"with {_SHUFFLED} select doc_id, sent_idx, new_idx from sh")
def _(spark, sf_dir):
    return masking.permuted(sents(spark, sf_dir)).select("doc_id", "sent_idx", "new_idx")


@query("reorder_prompt", f"with {_SHUFFLED} select doc_id, '[shuffled] ' || string_agg('<S' || new_idx || '> ' || sentence, ' ' order by new_idx) || ' [orig]' as input, string_agg(cast(sent_idx as varchar), ' ' order by new_idx) || ' <eos>' as target from sh group by doc_id")
def _(spark, sf_dir):
    return masking.reorder_prompts(masking.permuted(sents(spark, sf_dir))).select("doc_id", "input", "target")


@query("perplexity", "select round(exp(avg(loss / n)), 6) + 0.0 as macro, round(exp(sum(loss) / sum(n)), 6) + 0.0 as micro from (select cast(count(*) as double) as n, sum(ln(1 + length(text) % 97)) as loss from conversations group by conv_id)")
def _(spark, sf_dir):
    batches = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("double").alias("n_tokens"), F.sum(F.log1p(F.length("text") % 97)).alias("loss"))
    return masking.perplexity(batches)


@query("clean_generations", r"select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '(\w*\])', '', 'g'), '(\[\w*)', '', 'g'), ' +', ' ', 'g')) as text from conversations")
def _(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_generation(F.col("text")).alias("text"))


_LINE = r"""regexp_replace(regexp_replace(regexp_replace(array_to_string(tokens, ' '), ' ([.,;:!?)\]}%])', '\1', 'g'), '([(\[{$#]) ', '\1', 'g'), ' ?([''’]) ?(s|t|re|ve|m|ll|d)\b', '\1\2', 'g')"""


@query("summary_files", f"with {_LEAD}, lines as (select docset_id, split_part(docset_id, '-', 1) as stem, sent_idx, {_LINE} as line from run where running <= 100) select substr(stem, 1, length(stem) - 1) || '-' || right(stem, 1) || '.M.100.' || right(docset_id, 1) || '.4' as file, string_agg(line, chr(10) order by sent_idx) as text from lines group by docset_id, stem")
def _(spark, sf_dir):
    first = lead_sents(spark, sf_dir)
    lead = selection.lead_k(first).join(first.select("doc_id", "sent_idx", "tokens"), ["doc_id", "sent_idx"])
    return files.summary_texts(lead.select("docset_id", F.col("sent_idx").alias("order_idx"), "tokens"), 4)


@query("rouge_config", """with m as (select docset_id, string_agg('<M ID="' || doc_id || '">' || docset_id || '.' || doc_id || '</M>', chr(10) order by cast(doc_id as varchar)) as models from docs group by docset_id) select docset_id as base_id, concat_ws(chr(10), '<EVAL ID="' || docset_id || '">', '<PEER-ROOT>', 'peers', '</PEER-ROOT>', '<MODEL-ROOT>', 'models', '</MODEL-ROOT>', '<INPUT-FORMAT TYPE="SPL">', '</INPUT-FORMAT>', '<PEERS>', '<P ID="1">' || docset_id || '.1</P>', '<P ID="2">' || docset_id || '.2</P>', '</PEERS>', '<MODELS>', models, '</MODELS>', '</EVAL>') as eval from m""")
def _(spark, sf_dir):
    d = docs(spark, sf_dir)
    peers = d.select(F.col("docset_id").alias("base_id")).distinct().withColumn("method", F.explode(F.array(F.lit("1"), F.lit("2"))))
    return files.rouge_config(peers, d.select(F.col("docset_id").alias("base_id"), F.col("doc_id").cast("string").alias("annotator")), "peers", "models")


@query("llm_records", "with d as (select docset_id, doc_id, arg_min(sentence, sent_idx) as headline, string_agg(sentence, chr(10) order by sent_idx) as body, bool_or(sent_idx = 0) as gold from sents group by docset_id, doc_id) select docset_id as id, 1::bigint as category, arg_max(headline, doc_id) as title, count(*) as documents, count(*) filter (gold) as golds, md5(string_agg(body, chr(10) order by doc_id)) as digest from d group by docset_id")
def _(spark, sf_dir):
    every = sents(spark, sf_dir)
    packed = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    each = every.groupBy("docset_id", "doc_id").agg(F.transform(packed, lambda x: x["sentence"]).alias("sentences"))
    rows = each.select("docset_id", F.col("doc_id").alias("pos"), F.lit(1).alias("corpus"), F.element_at("sentences", 1).alias("headline"), "sentences")
    golds = every.where("sent_idx = 0").select("docset_id", T.detokenize(F.col("tokens")).alias("text"))
    found = files.llm_records(rows, golds)
    return found.select("id", "category", "title", F.size("text").alias("documents"), F.size("summary").alias("golds"), F.md5(F.array_join(F.flatten("text"), "\n")).alias("digest"))
