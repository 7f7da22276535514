"""The same results in SQL (DuckDB's dialect), where SQL can express them."""

from __future__ import annotations

_TEXTS = r"""
with texts as (
  select id, any_value(entity_id) owner, replace(replace(lower(nfc_normalize(arg_max(content, (updated_at, version)))), 'ß', 'ss'), 'ς', 'σ') t
  from memories where id is not null group by id),
"""
_RECORDS = (
    _TEXTS
    + r"""
parts as (
  select id, regexp_replace(t, '[^\p{L}\p{N}]+', '', 'g') plain,
    list_filter(regexp_split_to_array(t, '[;|\n\r\x{85}\x{2028}\x{2029}]+'), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) p
  from texts where t is not null),
keyed as (
  select id, plain, case when len(p) >= 2 and len(list_filter(p, lambda x: not regexp_matches(x, '(?s)^[^\p{L}\p{N}:=]*\p{L}+(?:[\s\p{Z}]+\p{L}+)?[^\p{L}\p{N}:=]*[:=].*$'))) = 0
    then list_sort(list_transform(p, lambda x: regexp_replace(regexp_extract(x, '^([^:=]*)[:=]', 1), '[^\p{L}\p{N}]+', '', 'g') || '=' || regexp_replace(regexp_replace(x, '^[^:=]*[:=]', ''), '[^\p{L}\p{N}]+', '', 'g')))::varchar end fields
  from parts),
lists as (select plain, min(fields) fields from keyed where fields is not null group by 1),
records as (select id, case when l.fields is not null then 'f' || l.fields else 'p' || plain end record from keyed left join lists l using (plain))
"""
)
SQL = {
    "p5_found": _RECORDS + "select * from (select min(id) over (partition by record) keep_id, id copy_id from records) where keep_id <> copy_id",
    "p5_records": _RECORDS + "select min(id) keep_id, count(*) copies from records group by record",
}
_NEAR = (
    _RECORDS
    + r""",
w as (select id, owner, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') w from texts where t is not null and owner is not null),
g as (select distinct id, owner, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] gram from (select id, owner, w, unnest(range(1, len(w) - 1)) i from w)),
n as (select id, count(*) n from g group by 1),
c as (select a.id a, b.id b, count(*) shared from g a join g b on a.owner = b.owner and a.gram = b.gram and a.id < b.id group by 1, 2)
select a memory_id_a, b memory_id_b from c join n x on x.id = a join n y on y.id = b join records r on r.id = a join records s on s.id = b
where shared >= 0.5 * (x.n + y.n - shared) and r.record <> s.record
"""
)
SQL["p6_found"] = _NEAR
SQL["p6_groups"] = (
    _NEAR.replace("with texts", "with recursive texts", 1).replace("select a memory_id_a", ", p as (select a memory_id_a", 1).rstrip()
    + """),
both_ways as (select memory_id_a a, memory_id_b b from p union select memory_id_b, memory_id_a from p),
reach as (select distinct a, a b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
roots as (select a id, min(b) root from reach group by 1),
sets as (select g.id, list_sort(list(gram)) grams from g group by 1),
classes as (select r.id, min(r.id) over (partition by w.owner, k.plain, k.fields, s.grams) class_id from roots r join w using (id) join keyed k using (id) join sets s using (id)),
linked as (select c.class_id, count(distinct d.class_id) links from both_ways e join classes c on c.id = e.a join classes d on d.id = e.b group by 1)
select r.id memory_id, root group_id, links from roots r join classes c using (id) join linked l using (class_id)
"""
)
_LEAKS = r"""
with d as (select distinct doc_id, list_filter(regexp_split_to_array(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents where text is not null),
i as (select distinct item_id, list_filter(regexp_split_to_array(replace(replace(lower(nfc_normalize(passage)), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from eval_items where passage is not null),
r as (select item_id, array_to_string(w[k:k + 11], ' ') phrase from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
o as (select phrase, min(item_id) item_id from r group by 1 having count(distinct item_id) = 1),
h as (select doc_id, k, array_to_string(w[k:k + 11], ' ') phrase from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)),
f as (select distinct doc_id, item_id, k from h join o using (phrase))
"""
SQL["p7_found"] = _LEAKS + "select distinct doc_id, item_id from f"
SQL["p7_items"] = _LEAKS + "select item_id, count(distinct doc_id) documents, count(*)::bigint words from (select distinct doc_id, item_id, k + unnest(range(0, 12)) from f) group by 1"
SQL["p2_found"] = """
with v as (
  select id, list_transform(arg_max(embedding, (updated_at, version)), lambda x: x::double) v from memories where id is not null and embedding is not null group by id),
u as (
  select id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from v
  where len(v) = 64 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
a as (select a.id a, b.id b, list_dot_product(a.u, b.u) c from u a join u b on a.id <> b.id),
r as (select *, row_number() over (partition by a order by c desc, b) n from a)
select distinct least(a, b) memory_id_a, greatest(a, b) memory_id_b from r where n <= 5 and c >= 0.93
"""
