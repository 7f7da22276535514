"""Queries of problem 3, references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlode.operators.references import MEMORY_TABLES, REPORTED_KEYS, orphan_cascade, orphan_report, orphans
from memlode.sources.parquet import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    names = {k.child for k in REPORTED_KEYS} | {k.parent for k in REPORTED_KEYS}
    return orphans({name: table(spark, folder, name) for name in sorted(names)})


def p3_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_cascade({name: table(spark, folder, name) for name in MEMORY_TABLES})


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p3_cascade(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_cascade": p3_cascade, "p3_report": p3_report}

_KEY = r"nullif(lower(regexp_replace({}, '^[\s\x{{200B}}\x{{FEFF}}]+|[\s\x{{200B}}\x{{FEFF}}]+$', '', 'g')), '')"
_BASE = f"""
with parents as (
  select 'memories' parent, {_KEY.format('id')} k, arg_max(created_at, (updated_at, version)) t, arg_max(lower(trim(state)) = 'deleted', (updated_at, version)) gone
  from memories where id is not null group by all
  union all
  select 'entities', {_KEY.format('id')}, arg_max(created_at, updated_at), false from entities where id is not null group by all),
refs as (
  select distinct 'entity_mentions' table_name, id record_id, 'memory_id' field_name, 'memories' parent, {_KEY.format('memory_id')} k, created_at row_time from entity_mentions
  union all
  select distinct 'surfaced_memories', id, 'memory_id', 'memories', {_KEY.format('memory_id')}, surfaced_at from surfaced_memories
  union all
  select 'relationships', id, 'source_entity_id', 'entities', {_KEY.format('arg_max(source_entity_id, updated_at)')}, arg_max(created_at, updated_at) from relationships group by id
  union all
  select 'relationships', id, 'target_entity_id', 'entities', {_KEY.format('arg_max(target_entity_id, updated_at)')}, arg_max(created_at, updated_at) from relationships group by id
  EXTRA),
judged as (
  select r.*, case when p.k is null then 'missing' when p.gone then 'deleted' when p.t > r.row_time then 'late' end reason
  from refs r left join parents p on p.parent = r.parent and p.k = r.k where r.k is not null)
"""
_EXTRA = f"""
  union all
  select distinct 'entity_mentions', id, 'entity_id', 'entities', {_KEY.format('entity_id')}, created_at from entity_mentions
  union all
  select distinct 'memories', id, 'derived_from', 'memories', {_KEY.format('d')}, created_at
  from (select id, arg_max(created_at, (updated_at, version)) created_at, unnest(arg_max(derived_from, (updated_at, version))) d from memories group by id)"""
_CASCADE = (
    "with recursive "
    + _BASE.replace("EXTRA", _EXTRA).strip().removeprefix("with ")
    + f""",
reach as (
  select table_name, record_id, 0 depth from judged where reason is not null
  union
  select j.table_name, j.record_id, c.depth + 1 from reach c join judged j on j.parent = c.table_name and j.k = {_KEY.format('c.record_id')} where j.reason is null and c.depth < 20),
depths as (select table_name, record_id, min(depth) depth from reach group by 1, 2),
rows_ as (
  select j.table_name, j.record_id, j.field_name, case min(case j.reason when 'missing' then 1 when 'deleted' then 2 else 3 end) when 1 then 'missing' when 2 then 'deleted' else 'late' end reason, min(j.row_time) t, 0 depth
  from judged j where j.reason is not null group by 1, 2, 3
  union all
  select j.table_name, j.record_id, j.field_name, 'inherited', min(j.row_time), d.depth
  from judged j join depths d on d.table_name = j.table_name and d.record_id = j.record_id join depths p on p.table_name = j.parent and {_KEY.format('p.record_id')} = j.k
  where j.reason is null and d.depth > 0 and p.depth = d.depth - 1 group by 1, 2, 3, d.depth),
result as (select table_name, record_id, field_name, reason, strftime(t, '%Y-%m') "month", case when depth = 0 then 'direct' else 'inherited' end kind, depth from rows_)
"""
)
SQL = {
    "p3_found": _BASE.replace("EXTRA", "") + "select table_name, record_id, field_name, reason, strftime(row_time, '%Y-%m') \"month\" from judged where reason is not null",
    "p3_cascade": _CASCADE + "select * from result",
    "p3_report": _CASCADE + "select table_name, \"month\", reason, count(distinct record_id) orphans from result group by 1, 2, 3",
}
