"""DuckDB SQL for the rows of the operators that SQL can express; it compares words themselves, not their hashes."""

from __future__ import annotations

#: A word of the contracts, quoted.
_WORD = r"'[^\x20\x09-\x0D]+'"

PARITY_JACCARD = rf"""
with recursive worded as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w from documents),
shingled as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from worded),
flat as materialized (select doc_id, len(s) as n, x from (select doc_id, s, unnest(s) as x from shingled)),
pairs as materialized (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.x = b.x and a.doc_id < b.doc_id and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as materialized (select a, b from pairs union all select b, a from pairs),
reach(node, least) as (
  select doc_id, doc_id from documents
  union
  select e.b, r.least from reach r join both_ways e on e.a = r.node where r.least < e.b),
labels as (select node, min(least) as component_id from reach group by node),
degrees as (select a as node, count(*) as n_links from both_ways group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, l.component_id, coalesce(g.n_links, 0) as n_links
from shingled s join labels l on l.node = s.doc_id left join degrees g on g.node = s.doc_id
"""

SUBSTRING_DEDUP = rf"""
with worded as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
windows as materialized (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from worded)),
firsts as (select x, min(doc_id) as first from windows group by x),
covered as materialized (
  select distinct doc_id, unnest(range(i, i + 13)) as i from windows join firsts using (x) where doc_id > first),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from worded),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as t from words anti join covered using (doc_id, i) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from worded d left join kept k using (doc_id)
"""
