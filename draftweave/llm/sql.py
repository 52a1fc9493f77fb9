"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from draftweave.llm.secrets import BASE, MORE

SQL: dict[str, str] = {}

#: A-Z lowered, everything else as it is.
LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD_LIST = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op1_decontaminate"] = f"""
with d as (select doc_id, {_WORD_LIST.format(LOWERED.format('text'))} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORD_LIST.format(LOWERED.format('text'))} as w from benchmark),
win as (
  select distinct item, array_to_string(w[s:s + n - 1], ' ') as gram, n
  from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0)
),
sizes as (select distinct n from win),
grams as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)
),
hits as (select g.doc_id, g.s, g.n, win.item from grams g join win on g.gram = win.gram and g.n = win.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by 1),
items as (select doc_id, list_sort(list(distinct item)) as items from hits group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(len(items.items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items.items, ','), '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

SQL["op9_exact_dedup"] = f"""
with d as (select doc_id, {LOWERED.format('text')} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g using (norm)
"""

_QUOTED = [
    (n, r.kind, r.pattern.replace("'", "''"), r.group, r.least, r.pattern.replace("'", "''") if r.kind != "hex" else "[0-9a-f]{16}")
    for n, r in enumerate(BASE + MORE)
]
_FOUND = " union all ".join(
    f"""select doc_id, {n} as kind, '{kind}' as name, {least} as least, unnest(range(1, len(m) + 1)) as i, m, g, gap
  from (select doc_id, regexp_extract_all(t, '{pattern}', 0) as m, regexp_extract_all(t, '{pattern}', {group}) as g,
    string_split_regex(t, '{pattern}') as gap from d where regexp_matches(t, '{guard}'))"""
    for n, kind, pattern, group, least, guard in _QUOTED
)

SQL["op6_secrets"] = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({_FOUND}),
placed as (
  select doc_id, kind, name, least, length(g[i]) as asked, length(m[i]) as size,
    sum(length(gap[i]) + length(m[i])) over (partition by doc_id, kind order by i) as e
  from found
),
good as (select doc_id, kind, name, e - size as s, e from placed where asked >= least),
listed as (
  select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
    string_agg(name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) filter (kind < {len(BASE)}) as base,
    string_agg(name || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, kind) as spans
  from good group by doc_id
)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (doc_id)
"""

#: CRC-32 of a string of ASCII characters: eight shifts a byte, with the reversed polynomial.
_SHIFTED = "list_reduce(list_prepend({}, range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda s: ascii(s)::bigint)), "
    "lambda a, b: xor(a >> 8, " + _SHIFTED.format("xor(a & 255, b)") + ")), 4294967295)"
)

SQL["op12_prefix_trie"] = f"""
with r as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
u as (select c, turn, role, length(text) as size, substr(sha256(length(role) || ':' || role || text), 1, 32) as unit from r),
t as (select *, row_number() over (partition by c order by turn nulls first, role, unit) as p from u),
n as (select c, count(*) as turns, {_CRC32.format('cast(c as varchar)')} % 6 as h from t group by c),
v as (select n.c, n.c - n.c % 100 as first, h, least(h, coalesce(m.turns, 0)) as taken from n left join (select c as f, turns from n) m on f = n.c - n.c % 100),
b as (
  select v.c, p - h + taken as p, unit, size from t join v on t.c = v.c and p > h
  union all select v.c, p, unit, size from v join t on t.c = v.first and p <= h
),
path as (
  select c, p, size, string_agg(unit, '') over (partition by c order by p) as name from b
  union all select c, 0, 0, '' from n
),
l as (select c, max(p) as last from path group by c),
node as (
  select name, any_value(path.p) as depth, min(c) as conv_id, count(*) as n_convs, any_value(size) as size, max(last > p) as inner_,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last = p), '')) as ends_sha256
  from path join l using (c) group by name
),
sub as (
  select path.name, sum(case when inner_ then 0 else 1 end) as n_leaves, sum((n_convs - 1) * node.size) as saved_tokens
  from node join path on path.c = node.conv_id and path.p <= node.depth group by path.name
),
child as (select left(name, length(name) - 32) as name, count(*) as n_children from node where depth > 0 group by 1)
select node.conv_id, cast(depth as bigint) as depth, up.conv_id as parent_conv_id, n_convs, coalesce(n_children, 0) as n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from node join sub using (name) left join child using (name)
  left join (select name as above, conv_id from node) up on depth > 0 and above = left(node.name, length(node.name) - 32)
"""
