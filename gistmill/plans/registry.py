"""The queries of the library, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import text as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions to six places, so that engines agree."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind in ("double", "float"):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        out.append(column.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: settled(f(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_tables(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gistmill.plans import chains, texts, vectors  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- SQL for the shared tables ------------------------------------------------------------------------------------


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cleaned(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    for pattern, by in T.REMOVED:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return out


_DROPPED = " or ".join([r"not regexp_matches(clean, '\S')", *(f"contains(clean, {quoted(x)})" for x in T.COPYRIGHT)])
_STOP = ", ".join(map(quoted, T.STOPWORDS))

#: Common table expressions, each after those that it reads.
TABLES = {
    "docs": "select source || '-' || cast(doc_id // 200 as varchar) as docset_id, doc_id, lang, text from documents",
    "paras": f"select docset_id, doc_id, i - 1 as para_idx, {_cleaned('p')} as clean from (select docset_id, doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) as i from docs)",
    "kept": f"select docset_id, doc_id, row_number() over (partition by doc_id order by para_idx) - 1 as para_idx, clean from paras where not ({_DROPPED})",
    "pieces": f"select docset_id, doc_id, para_idx, unnest(l) as s, generate_subscripts(l, 1) as k from (select *, regexp_extract_all(clean, {quoted(T.SENTENCE)}) as l from kept)",
    "sents": rf"select docset_id, doc_id, para_idx, row_number() over (partition by doc_id order by para_idx, k) - 1 as sent_idx, sentence, regexp_extract_all(sentence, {quoted(T.TOKEN)}) as tokens from (select *, regexp_replace(s, '^\s+|\s+$', '', 'g') as sentence from pieces) where sentence <> ''",
    "worded": rf"select docset_id, doc_id, sent_idx, list_transform(list_filter(tokens, lambda x: regexp_matches(x, {quoted(T.WORD)}) or starts_with(x, '&')), lambda x: lower(x)) as words from sents",
    "terms": "select docset_id, doc_id, sent_idx, unnest(words) as term from worded",
    "content": f"select * from terms where term not in ({_STOP})",
    "tf_sent": "select docset_id, doc_id, sent_idx, term, count(*) as tf from terms group by all",
    "tf_set": "select docset_id, term, count(*) as tf from terms group by all",
    "df_set": "select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf_set group by term",
    "n_set": "select cast(count(distinct docset_id) as double) as units from tf_set",
    "tf_con": "select docset_id, doc_id, sent_idx, term, count(*) as tf from content group by all",
    "idf_con": "select term, 0.7 + ln((select count(*) from (select distinct docset_id, doc_id, sent_idx from tf_con)) / (count(*) + 0.7)) as idf from tf_con group by term",
    "vec": "select docset_id, doc_id, sent_idx, term, ln(1 + tf) * idf as w from tf_con join idf_con using (term)",
    "unit": "select docset_id, term, doc_id * 1000000 + sent_idx as node, w / sqrt(sum(w * w) over (partition by docset_id, doc_id, sent_idx)) as u from vec",
    "half": "select a.docset_id, a.node as i, b.node as j, sum(a.u * b.u) as w from unit a join unit b on a.docset_id = b.docset_id and a.term = b.term and a.node < b.node group by all having sum(a.u * b.u) >= 0.3",
    "edges": "select docset_id, i, j, w from half union all select docset_id, j, i, w from half",
    "placed": "select *, sent_idx / cast(count(*) over (partition by doc_id) as double) as frac from sents",
}
_NEEDS = {
    "paras": "docs", "kept": "paras", "pieces": "kept", "sents": "pieces", "worded": "sents", "terms": "worded", "content": "terms", "tf_sent": "terms", "tf_set": "terms",
    "df_set": "tf_set", "n_set": "tf_set", "tf_con": "content", "idf_con": "tf_con", "vec": "tf_con idf_con", "unit": "vec", "half": "unit", "edges": "half", "placed": "sents",
}


def with_tables(sql: str) -> str:
    """The statement with the common tables that it reads before it."""
    import re

    wanted: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, "").split():
            add(x)
        if name not in wanted:
            wanted.append(name)

    for name in TABLES:
        if re.search(rf"\b(from|join) {name}\b", sql):
            add(name)
    body = sql.strip()
    start = re.match(r"with (recursive )?", body, re.IGNORECASE)
    ctes = [f"{x} as materialized ({TABLES[x]})" for x in wanted]
    if start:
        return start[0] + ", ".join([*ctes, body[start.end() :]])
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
