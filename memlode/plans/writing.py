"""Commands, resolution, paths, histories: named queries and their SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import NOW, at, dot
from memlode.operators import commands, filters, graph, index, lifecycle, logs, scoring, search, signals, texts
from memlode.plans.base import _KEY, WITH, Catalog, actions, entities, memories, mentions, messages, relationships
from memlode.plans.insight import _COLS, _DEAD, _DECAYING, _EDGES, _PEND, _REL, _graph
from memlode.plans.relational import HOT
from memlode.plans.search import _VEC, _VPAIRS, query_vector
from memlode.runtime import own_dir
from memlode.sources.parquet import clean_key, table

C = Catalog()
_RECURSIVE = lambda sql: "with recursive " + sql.strip().removeprefix("with ")

# ---- entities and relationships that extraction finds

_FOUND = """, found as (select m.entity_id "owner", n.memory_id, n.mention_text "name", coalesce(e.type, 'other') "type", n.context_snippet snippet, coalesce(n.confidence, 0.9) confidence from men n join mem m on m.id = n.memory_id left join ent e on e.id = n.entity_id where n.mention_text is not null),
exact as (select owner_entity_id "owner", canonical_name "name", "type", min(id) x from ent group by all),
ali as (select "owner", k, min(id) a from (select id, owner_entity_id "owner", lower(unnest(list_append(coalesce(aliases, []), canonical_name))) k from ent) where k is not null group by all),
names as (select f."owner", f."name", f."type", coalesce(x, a, 'n' || substr(sha256(f."owner" || chr(31) || f."name" || chr(31) || f."type"), 1, 16)) entity_id, case when x is not null then 'exact' when a is not null then 'alias' else 'new' end how from (select distinct "owner", "name", "type" from found where "owner" is not null) f left join exact using ("owner", "name", "type") left join ali on ali."owner" = f."owner" and ali.k = lower(f."name"))
"""


def _found(spark, folder):
    owners = memories(spark, folder, "entity_id").select(F.col("id").alias("memory_id"), F.col("entity_id").alias("owner"))
    kinds = entities(spark, folder, "type").withColumnRenamed("id", "entity_id")
    said = mentions(spark, folder, "memory_id", "entity_id", "mention_text", "context_snippet", "confidence").join(owners, "memory_id").join(kinds, "entity_id", "left").where("mention_text is not null")
    return said.select("owner", "memory_id", F.col("mention_text").alias("name"), F.coalesce("type", F.lit("other")).alias("type"), F.col("context_snippet").alias("snippet"), F.coalesce("confidence", F.lit(0.9)).alias("confidence"))


_ENT = ("owner_entity_id", "canonical_name", "type", "aliases")


@C.add(WITH + _FOUND + 'select "owner", "name", "type", entity_id, how from names')
def resolve_owner(spark, folder):
    return commands.resolved_for_owner(_found(spark, folder), entities(spark, folder, *_ENT)).select("owner", "name", "type", "entity_id", "how")


@C.add(WITH + _FOUND + """select memory_id, entity_id, max(f.confidence) confidence from found f join names using ("owner", "name", "type") group by 1, 2""")
def store_mentions(spark, folder):
    return commands.stored_mentions(_found(spark, folder), entities(spark, folder, *_ENT))[1].select("memory_id", "entity_id", "confidence")


@C.add(WITH + _FOUND + """select entity_id id, "owner" owner_entity_id, "name" canonical_name, "type" from names where how = 'new'""")
def store_entities(spark, folder):
    return commands.stored_mentions(_found(spark, folder), entities(spark, folder, *_ENT))[0]


_TOLD = f""", r as (select id, owner_entity_id "owner", {_KEY.format('source_entity_id')} s, {_KEY.format('target_entity_id')} t, regexp_replace(lower(trim(relationship_type)), '[\\s-]+', '_', 'g') kind, strength, confidence, evidence_count from rel),
ali as (select "owner", k, min(id) id from (select id, owner_entity_id "owner", lower(unnest(list_append(coalesce(aliases, []), canonical_name))) k from ent) where k is not null group by all),
told as (select r."owner", a.id s, b.id t, r.kind, round(r.confidence * 1.1, 6) confidence from r join ent x on x.id = r.s join ent y on y.id = r.t join ali a on a."owner" = r."owner" and a.k = lower(x.canonical_name) join ali b on b."owner" = r."owner" and b.k = lower(y.canonical_name) where a.id <> b.id and r.confidence is not null),
summed as (select "owner", s, t, kind, max(confidence) c, count(*) n from told group by all),
old as (select "owner", s, t, kind, min(id) id, arg_min(strength, id) strength, arg_min(evidence_count, id) evidence_count from r group by 1, 2, 3, 4)
"""


def _relations(spark, folder):
    rows = relationships(spark, folder, "owner_entity_id", "source_entity_id", "target_entity_id", "relationship_type", "strength", "confidence", "evidence_count")
    kind = F.regexp_replace(F.lower(F.trim("relationship_type")), r"[\s-]+", "_")
    return rows.withColumns({"source_entity_id": clean_key(F.col("source_entity_id")), "target_entity_id": clean_key(F.col("target_entity_id")), "relationship_type": kind})


@C.add(WITH + _TOLD + """select "owner", s.s source_entity_id, s.t target_entity_id, s.kind, case when o.id is null then c when c > o.strength then (o.strength + c) / 2 else o.strength end strength, coalesce(o.evidence_count, 0) + n evidence_count, o.id is null is_new
from summed s left join old o using ("owner", s, t, kind)""")
def store_relationships(spark, folder):
    rows, known = _relations(spark, folder), entities(spark, folder, *_ENT)
    names = known.select("id", "canonical_name")
    said = rows.join(names.toDF("source_entity_id", "source"), "source_entity_id").join(names.toDF("target_entity_id", "target"), "target_entity_id").where("confidence is not null")
    found = said.select(F.col("owner_entity_id").alias("owner"), F.lit("").alias("memory_id"), "source", "target", F.col("relationship_type").alias("kind"), F.round(F.col("confidence") * 1.1, 6).alias("confidence"), F.lit("").alias("evidence"))
    made = commands.stored_relationships(found, known, rows)[0]
    return made.select("owner", "source_entity_id", "target_entity_id", "kind", "strength", "evidence_count", "is_new")


@C.add(WITH + ", e as (select id relationship_id, last_seen_at + interval 1 day seen_at from rel where confidence > 0.5) select r.id, r.evidence_count + count(e.relationship_id) evidence_count, max(greatest(r.last_seen_at, e.seen_at)) last_seen_at from rel r left join e on e.relationship_id = r.id group by r.id, r.evidence_count")
def add_evidence(spark, folder):
    rows = relationships(spark, folder, "evidence_count", "last_seen_at", "confidence")
    evidence = rows.where("confidence > 0.5").select(F.col("id").alias("relationship_id"), (F.col("last_seen_at") + F.expr("interval 1 day")).alias("seen_at"))
    return commands.evidence_added(rows, evidence).select("id", F.col("evidence_count").cast("bigint").alias("evidence_count"), "last_seen_at")


@C.add(WITH + f"select 'memories' \"table_name\", count(*) left_over from mem where entity_id is distinct from '{HOT}' union all select 'entities', count(*) from ent where owner_entity_id is distinct from '{HOT}' union all select 'relationships', count(*) from rel where owner_entity_id is distinct from '{HOT}'")
def delete_owner_everywhere(spark, folder):
    tables = {"memories": memories(spark, folder, "entity_id"), "entities": entities(spark, folder, "owner_entity_id"), "relationships": relationships(spark, folder, "owner_entity_id")}
    left = commands.without_owner(tables, HOT, {"memories": "entity_id", "entities": "owner_entity_id", "relationships": "owner_entity_id"})
    parts = [df.agg(F.count("*").alias("left_over")).select(F.lit(name).alias("table_name"), "left_over") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@C.add(WITH + "select id, owner_entity_id, strength from (select *, row_number() over (partition by owner_entity_id order by strength desc nulls last, id) n from rel) where n <= 10")
def relationship_rank(spark, folder):
    w = Window.partitionBy("owner_entity_id").orderBy(F.col("strength").desc_nulls_last(), "id")
    return relationships(spark, folder, "owner_entity_id", "strength").withColumn("n", F.row_number().over(w)).where("n <= 10").select("id", "owner_entity_id", "strength")


@C.add(WITH + ", r as (select *, row_number() over (partition by entity_id order by created_at desc, id) n from men) select id, entity_id, created_at from r where n <= 5")
def newest_mentions(spark, folder):
    w = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id")
    return mentions(spark, folder, "entity_id", "created_at").withColumn("n", F.row_number().over(w)).where("n <= 5").select("id", "entity_id", "created_at")


# ---- graph


def _pairs_of_owners(spark, folder):
    return entities(spark, folder, "owner_entity_id").groupBy("owner_entity_id").agg(F.min("id").alias("id")).select("id")


_WALK = """, root as (select min(id) id from ent group by owner_entity_id),
walk as (select id root, id node, 0 depth, [id] path from root union select root, b, depth + 1, list_append(path, b) from walk join edge on a = node where depth < 3 and not list_contains(path, b)),
short as (select root, node, min(depth) depth from walk group by all),
path as (select w.root, w.node, w.depth, min(w.path) path from walk w join short using (root, node, depth) group by all)
"""


@C.add(_RECURSIVE(WITH + _EDGES + _WALK) + "select root, node, depth, array_to_string(path, '>') path from path")
def graph_paths(spark, folder):
    found = graph.paths(_graph(spark, folder), _pairs_of_owners(spark, folder), 3)
    return found.select("root", "node", "depth", F.array_join("path", ">").alias("path"))


_LABELS = """, best as (select a, b, arg_min(kind, (-strength, kind)) kind from edge group by all),
flat as (select root, node, unnest(range(1, len(path))) step, path from path where depth > 0),
steps as (select f.root, f.node, f.step, f.path[f.step] a, f.path[f.step + 1] b, k.kind from flat f join best k on k.a = f.path[f.step] and k.b = f.path[f.step + 1])
"""


@C.add(_RECURSIVE(WITH + _EDGES + _WALK + _LABELS) + "select root, node, step, a, b, kind from steps")
def path_labels(spark, folder):
    edges = _graph(spark, folder)
    return graph.path_steps(graph.paths(edges, _pairs_of_owners(spark, folder), 3), edges)


@C.add(_RECURSIVE(WITH + _EDGES + _WALK + _LABELS) + "select root, node, any_value(x.canonical_name) || string_agg(' -[' || kind || ']-> ' || y.canonical_name, '' order by step) \"text\" from steps join ent x on x.id = root join ent y on y.id = b group by root, node")
def explain_paths(spark, folder):
    edges = _graph(spark, folder)
    return graph.explained(graph.path_steps(graph.paths(edges, _pairs_of_owners(spark, folder), 3), edges), entities(spark, folder, "canonical_name"))


@C.add(WITH + _EDGES.replace("select id from ent", "select id from ent where type in ('person', 'organization')") + "select a, count(*) n from edge where kind in (select kind from edge group by 1 having count(*) > 20) group by 1")
def edges_filtered(spark, folder):
    rows = graph.edges(relationships(spark, folder, *_REL), entities(spark, folder, "type"), entity_types=("person", "organization"))
    often = rows.groupBy("kind").agg(F.count("*").alias("n")).where("n > 20").select("kind")
    return rows.join(often, "kind", "left_semi").groupBy("a").agg(F.count("*").alias("n"))


@C.add(WITH + _EDGES + f", ids as (select id from ({_PEND})) , hit as (select distinct n.entity_id a from men n join ids on ids.id = n.memory_id) select distinct x.owner_entity_id \"owner\", x.canonical_name || ' (' || x.type || ') -[' || e.kind || ']-> ' || y.canonical_name || ' (' || y.type || ')' line from edge e join hit using (a) join ent x on x.id = e.a join ent y on y.id = e.b")
def context_lines(spark, folder):
    ids = signals.pending(memories(spark, folder, *_COLS), NOW).select("id")
    return graph.context_lines(ids, mentions(spark, folder, "memory_id", "entity_id"), entities(spark, folder, "owner_entity_id", "canonical_name", "type"), _graph(spark, folder))


_TYPED = """, t as (select id, content, unnest([{'p': 'person', 'n': regexp_extract_all(content, '(?:my|the)\\s+(?:friend|colleague|coworker|boss|manager)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1)}, {'p': 'organization', 'n': regexp_extract_all(content, '(?:works?\\s+(?:at|for))\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1)},
{'p': 'location', 'n': regexp_extract_all(content, '(?:lives?\\s+in|from)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1)}, {'p': 'person', 'n': regexp_extract_all(content, '(?:married\\s+to|dating)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)', 1)}]) e from mem),
u as (select distinct id, content, e.p "type", unnest(e.n) "name" from t),
v as (select id, "name", "type", strpos(lower(content), lower("name")) s, content from u),
w as (select id, "name", "type", case when s = 0 then '' else substr(content, greatest(s - 50, 1), s + length("name") + 50 - greatest(s - 50, 1)) end context from v)
"""


def _kinds() -> str:
    said = lambda parts: " or ".join(f"contains(lower(context), '{p}')" for p in parts)
    return "case " + " ".join(f"when {said(parts)} then '{kind}'" for kind, parts in graph.TYPE_WORDS) + " else 'other' end"


@C.add(WITH + _TYPED + f"select id, \"name\", \"type\", context, {_kinds()} inferred from w")
def typed_entities(spark, folder):
    return graph.typed_entities(memories(spark, folder, "content"))


# ---- conflicts, resolution

_NEAR = _VPAIRS + ", near as (select a, b, ca, cb, c from p where c >= 0.7 - 1e-9)"


def _close(spark, folder, least, *columns):
    rows = memories(spark, folder, "entity_id", "embedding", "state", "content", *columns).where((F.col("state") == "active") & (F.size("embedding") == 64))
    return rows, search.similarity_pairs(rows, "entity_id", least)


@C.add(WITH + _NEAR + """, said as (select a, ca, cb, case a_.memory_type when 'PLAN' then 'use_new' when 'EVENT' then 'keep' when 'CONTEXT' then 'merge' when 'ACTIVITY' then 'both' else 'ask' end r from near join mem a_ on a_.id = near.a),
t as (select a id, case r when 'use_new' then cb when 'merge' then ca || ' (Updated: ' || cb || ')' end content, case r when 'merge' then 'conflict_merge' else 'conflict_resolution' end operation from said)
select id, max(content) content, arg_max(operation, content) operation from t where content is not null group by 1""")
def resolve_conflicts(spark, folder):
    rows, near = _close(spark, folder, 0.7, "memory_type")
    kind = F.col("memory_type")
    said = F.when(kind == "PLAN", "use_new").when(kind == "EVENT", "keep").when(kind == "CONTEXT", "merge").when(kind == "ACTIVITY", "both").otherwise("ask")
    old = rows.select(F.col("id").alias("a"), F.col("content").alias("old"), said.alias("resolution"))
    pairs = near.join(old, "a").join(rows.select(F.col("id").alias("b"), F.col("content").alias("new")), "b").select(F.col("a").alias("old_id"), "old", "new", "resolution", F.lit(None).cast("string").alias("merged"))
    return commands.conflict_resolved(pairs)


_TWO = """, wide as (select a, b, c from p where c >= {} - 1e-9), both_ways as (select a, b, c from wide union all select b, a, c from wide)
"""


def _new_pairs(spark, folder, least):
    """Pairs of a memory of the last ten days with an older one of its owner: only these two sides are compared."""
    rows = memories(spark, folder, "entity_id", "embedding", "state", "created_at", "memory_type", "importance").where((F.col("state") == "active") & (F.size("embedding") == 64))
    new = F.col("created_at") > at(NOW - timedelta(days=10))
    return rows, rows.where(new), search.similarity_between(rows.where(new), rows.where(~new), "entity_id", least)


@C.add(WITH + _VPAIRS + _TWO.format(0.7) + """select o.id, min(n.id) "by" from both_ways join mem n on n.id = a join mem o on o.id = b where n.created_at > timestamp '2024-01-22' and o.created_at <= timestamp '2024-01-22' and n.memory_type in ('EVENT', 'CONTEXT') and o.memory_type in ('PLAN', 'ACTIVITY') group by 1""")
def auto_resolve(spark, folder):
    rows, new, near = _new_pairs(spark, folder, 0.7)
    return commands.superseded(near, rows, new)


@C.add(WITH + _VPAIRS + _TWO.format(0.5) + """select n.id new_id, o.id, round(c, 6) similarity from both_ways join mem n on n.id = a join mem o on o.id = b where n.created_at > timestamp '2024-01-22' and o.created_at <= timestamp '2024-01-22' and c between 0.5 and 0.85 and o.memory_type in ('IDENTITY', 'PLAN', 'RELATIONSHIP') and o.importance > 0.5""")
def judge_anew(spark, folder):
    rows, _, near = _new_pairs(spark, folder, 0.5)
    return commands.to_judge_anew(near, rows).withColumn("similarity", F.round("similarity", 6))


# ---- schedules
_CRON = "len(list_filter(tags, lambda t: starts_with(t, 'cron:'))) > 0"
_ASKED = f", asked as (select id request_id, entity_id, agent_id, content, 'cron:daily:09:00' cron_tag from mem where state = 'stale' and {_CRON} and agent_id is not null)"


def _schedules(spark, folder):
    return memories(spark, folder, "entity_id", "agent_id", "team_id", "content", "tags", "state", "created_at", "last_accessed_at", "access_count")


def _asked(rows):
    return rows.where((F.col("state") == "stale") & commands.has_cron(F.col("tags")) & F.col("agent_id").isNotNull()).select(F.col("id").alias("request_id"), "entity_id", "agent_id", "content", F.lit("cron:daily:09:00").alias("cron_tag"))


@C.add(WITH + _ASKED + f"select m.id, min(request_id) request_id from mem m join asked q using (entity_id, agent_id) where m.state = 'active' and {_CRON.replace('tags', 'm.tags')} and (contains(lower(trim(m.content)), lower(trim(q.content))) or contains(lower(trim(q.content)), lower(trim(m.content)))) group by 1")
def schedule_replaced(spark, folder):
    rows = _schedules(spark, folder)
    return commands.schedules_replaced(rows, _asked(rows))


@C.add(WITH + _ASKED + ", teams as (select agent_id, max(team_id) team_id from mem where coalesce(team_id, '') <> '' group by 1) select 's' || substr(sha256(request_id), 1, 16) id, entity_id, agent_id, coalesce(team_id, '') team_id, case when team_id is null then 'private' else 'team' end visibility, sha256(content) content_hash, ['cron:daily:09:00'] tags from asked left join teams using (agent_id)")
def schedule_created(spark, folder):
    rows = _schedules(spark, folder)
    teams = rows.where(F.coalesce("team_id", F.lit("")) != "").groupBy("agent_id").agg(F.max("team_id").alias("team_id"))
    return commands.schedules_created(_asked(rows), teams, NOW).select("id", "entity_id", "agent_id", "team_id", "visibility", "content_hash", "tags")


@C.add(WITH + f"select id, list_append(list_filter(tags, lambda t: not starts_with(t, 'cron:')), 'cron:weekly:mon:08:00') tags, 'active' state from mem where {_CRON} and state = 'stale'")
def schedule_updated(spark, folder):
    rows = _schedules(spark, folder)
    changes = rows.where("state = 'stale'").select("id", F.lit("cron:weekly:mon:08:00").alias("cron_tag"), F.lit(None).cast("string").alias("content"))
    return commands.schedules_updated(rows, changes).select("id", "tags", "state")


@C.add(WITH + f"select id, 'archived' state from mem where {_CRON} and entity_id = '{HOT}'")
def schedule_cancelled(spark, folder):
    rows = _schedules(spark, folder)
    return commands.schedules_cancelled(rows, rows.where(F.col("entity_id") == HOT).select("id"))


@C.add()
def schedule_acknowledged(spark, folder):
    rows = _schedules(spark, folder)
    return commands.schedules_acknowledged(rows, rows.where("state = 'active'").select("id"), NOW)


@C.add(WITH + f"select id, 'active' state, state = 'stale' recovered from mem where {_CRON} and state in ('active', 'stale')")
def schedule_list(spark, folder):
    return commands.schedules_listed(_schedules(spark, folder)).select("id", "state", "recovered")


# ---- histories


@C.add("""with v as (select distinct id, updated_at, version, state, importance from memories where id is not null), r as (select *, row_number() over w number, lag(state) over w s, lag(importance) over w i from v window w as (partition by id order by updated_at, version, state, importance))
select id, number, 'state' "column", s "old", state "new" from r where number > 1 and s is distinct from state union all select id, number, 'importance', i::varchar, importance::varchar from r where number > 1 and i is distinct from importance""")
def audit_history(spark, folder):
    rows = table(spark, folder, "memories")
    return commands.changes_of(rows, "id", ["updated_at", "version"], ["state", "importance"])


@C.add(WITH + ", r as (select *, lag(decision) over (partition by entity_id order by acted_at, id) b from act) select entity_id, arg_max(decision, (acted_at, id)) state, count(*) changes, max(acted_at) since from r where b is distinct from decision group by 1")
def agent_states(spark, folder):
    return commands.latest_states(actions(spark, folder), ["entity_id"], ["acted_at", "id"], "decision")


@C.add(WITH + ", a as (select agent_id, arg_max(coalesce(team_id, ''), (created_at, coalesce(team_id, ''))) team_id from mem where agent_id is not null and created_at is not null group by 1) select * from a where team_id <> ''")
def team_members(spark, folder):
    return commands.team_members(memories(spark, folder, "agent_id", "team_id", "created_at").where("created_at is not null").withColumnRenamed("created_at", "assigned_at"))


@C.add(WITH + "select id, entity_id, session_id from (select *, row_number() over (partition by entity_id order by created_at desc, id) n from msg) where n <= 20")
def session_log(spark, folder):
    w = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id")
    return messages(spark, folder).withColumn("n", F.row_number().over(w)).where("n <= 20").select("id", "entity_id", "session_id")


# ---- signals


def _silent(spark, folder):
    """Entities with the vector of the first sound memory that mentions them."""
    rows = memories(spark, folder, "entity_id", "embedding", "memory_type", "state", "expires_at").where(F.size("embedding") == 64)
    said = mentions(spark, folder, "memory_id", "entity_id", "created_at")
    first = said.join(rows.select(F.col("id").alias("memory_id"), "embedding"), "memory_id").groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct("memory_id", "embedding")).alias("m"))
    return rows, said, entities(spark, folder, "owner_entity_id").join(first.select("id", "m.embedding"), "id")


@C.add(WITH + _VEC.rsplit(",\ns as", 1)[0] + """, sound as (select id, entity_id, memory_type, state, expires_at, list_transform(e, lambda x: x / sqrt(nn)) u from n where nn > 0 and nn < 'infinity'::double),
first as (select e.id, e.owner_entity_id "owner", arg_min(v.u, v.id) u, arg_min(v.id, v.id) k from men n join mem m on m.id = n.memory_id and len(m.embedding) = 64 left join sound v on v.id = m.id join ent e on e.id = n.entity_id group by 1, 2),
pick as (select f.id, f."owner", v.u from (select e.id, e.owner_entity_id "owner", min(m.id) k from men n join mem m on m.id = n.memory_id and len(m.embedding) = 64 join ent e on e.id = n.entity_id group by 1, 2) f join sound v on v.id = f.k),
last as (select entity_id id, max(created_at) t from men group by 1),
quiet as (select e.id, e.owner_entity_id "owner", floor((epoch_us(timestamp '2024-02-01') - epoch_us(t)) / 86400000000.0)::int "days" from ent e join last using (id) where (epoch_us(timestamp '2024-02-01') - epoch_us(t)) >= 7 * 86400000000),
near as (select * from (select p.id, s.expires_at, row_number() over (partition by p.id order by round(list_dot_product(p.u, s.u), 9) desc, s.id) r from pick p join sound s on s.entity_id = p."owner" where s.memory_type = 'PLAN' and s.state = 'active' and list_dot_product(p.u, s.u) >= 0.4 - 1e-9) where r <= 10),
g as (select id, count(*) plans, bool_or(expires_at < timestamp '2024-02-15') soon from near group by 1)
select id, "owner", "days" days_silent, coalesce(plans, 0) plans, case when plans is null then 'info' when coalesce(soon, false) then 'urgent' else 'attention' end urgency from quiet left join g using (id) where plans is not null or "days" > 14""")
def sig_relationships(spark, folder):
    rows, said, named = _silent(spark, folder)
    plans = rows.where((F.col("memory_type") == "PLAN") & (F.col("state") == "active"))
    return signals.relationships(entities(spark, folder, "owner_entity_id"), said, named, plans, NOW)


_SNAP = ", snap as (select entity_id, id, acted_at, ['no_activity', 'stalled', 'at_risk', 'on_track'][(id % 4 + 1)::int] goal, (id % 23)::int silence, ['declining', 'stable', 'improving'][(id % 3 + 1)::int] mood from act where decision = 'act'), l as (select *, lag(goal) over w g, lag(silence) over w s, lag(mood) over w m from snap window w as (partition by entity_id order by acted_at, id))"
_RANK = "list_position(['no_activity', 'stalled', 'at_risk', 'on_track'], {})"


@C.add(WITH + _SNAP + f" select id, 'goal_improved' delta from l where {_RANK.format('goal')} > {_RANK.format('g')} union all select id, 'entity_reengaged' from l where s > 7 and silence < s // 2 union all select id, 'sentiment_improved' from l where m = 'declining' and mood in ('stable', 'improving')")
def snapshot_deltas(spark, folder):
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int"))
    rows = actions(spark, folder).where("decision = 'act'")
    snapshots = rows.select("entity_id", "id", "acted_at", F.create_map(F.lit("g"), pick("no_activity", "stalled", "at_risk", "on_track")).alias("goals"), F.create_map(F.lit("e"), (F.col("id") % 23).cast("int")).alias("silences"), pick("declining", "stable", "improving").alias("mood"))
    return logs.snapshot_deltas(snapshots).select("id", "delta")


@C.add(WITH + f"""select agent_id, count(*) filter (k = 'pending') pending, count(*) filter (k = 'deadlines') deadlines, count(*) filter (k = 'decaying') decaying, count(*) filter (k = 'conflicts') conflicts
from (select id, 'pending' k from ({_PEND}) union all select id, 'deadlines' from ({_DEAD}) union all select id, 'decaying' from ({_DECAYING}) union all select id, 'conflicts' from mem where len(list_filter(confidence_factors, lambda f: starts_with(f, 'conflict_flagged:'))) > 0) x join mem using (id) group by 1""")
def signals_by_agent(spark, folder):
    rows = memories(spark, folder, *_COLS, "agent_id")
    named = {"pending": signals.pending(rows, NOW), "deadlines": signals.deadlines(rows, NOW), "decaying": signals.decaying(rows), "conflicts": signals.flagged(rows)}
    return signals.by_agent(named)


@C.add(WITH + f"""select entity_id, count(*) total, count(*) filter (k = 'pending') pending, count(*) filter (k = 'deadlines') deadlines, count(*) filter (k = 'decaying') decaying from (select id, entity_id, 'pending' k from ({_PEND}) union all select id, entity_id, 'deadlines' from ({_DEAD}) union all select id, entity_id, 'decaying' from ({_DECAYING})) group by 1""")
def signal_summary(spark, folder):
    rows = memories(spark, folder, *_COLS)
    return signals.summary({"pending": signals.pending(rows, NOW), "deadlines": signals.deadlines(rows, NOW), "decaying": signals.decaying(rows)})


@C.add(WITH + f"""select entity_id, string_agg(line, chr(10) order by line) "text" from (select entity_id, 'decaying: ' || substr(content, 1, 60) line, row_number() over (partition by entity_id order by id) n from mem where id in (select id from ({_DECAYING}))) where n <= 3 group by 1""")
def summary_text(spark, folder):
    rows = signals.decaying(memories(spark, folder, *_COLS))
    return signals.summary_text({"decaying": rows}, each=3)


_LOG = ", c as (select * from (select *, row_number() over (partition by entity_id order by acted_at desc, id desc) n from act)), cur as (select entity_id, id, acted_at t, fingerprint f, [decision, trigger_category, (id % 3)::varchar] k from c where n = 1), old as (select entity_id, id, acted_at t, fingerprint f, decision d, [decision, trigger_category, (id % 3)::varchar] k from c where n > 1)"


@C.add(WITH + _LOG + """ select cur.entity_id, case when bool_or(old.d = 'act' and old.t >= cur.t - interval 48 hour and old.f = cur.f and len(list_intersect(cur.k, old.k)) / len(cur.k) > 0.85) then 'overlap' when bool_or(old.d <> 'act' and old.t >= cur.t - interval 96 hour and old.f = cur.f) then 'suppressed' else 'fresh' end verdict from cur left join old using (entity_id) group by 1""")
def topic_repeat(spark, folder):
    w = Window.partitionBy("entity_id").orderBy(F.desc("acted_at"), F.desc("id"))
    rows = actions(spark, folder).withColumn("topics", F.array("decision", "trigger_category", (F.col("id") % 3).cast("string"))).withColumn("n", F.row_number().over(w))
    return logs.repeated_topics(rows.where("n = 1"), rows.where("n > 1"), timedelta(hours=48))


# ---- smaller ones


@C.add(WITH + "select count(*) filter (memory_type not in ('IDENTITY','PREFERENCE','RELATIONSHIP','EVENT','ACTIVITY','PLAN','CONTEXT','EPHEMERAL') or memory_type is null) bad_type, count(*) filter (coalesce(importance not between 0 and 1, true)) bad_importance, count(*) filter (coalesce(confidence not between 0 and 1, true)) bad_confidence, count(*) filter (coalesce(length(trim(content)) not between 1 and 5000, true)) bad_content from mem")
def rejected(spark, folder):
    rows = filters.with_reasons(memories(spark, folder, "memory_type", "importance", "confidence", "content"))
    return rows.agg(*[F.count_if(F.array_contains("reasons", r)).alias(f"bad_{r}") for r in ("type", "importance", "confidence", "content")])


@C.add(WITH + "select id, sum(strlen(content) + 256) over (partition by entity_id order by importance desc nulls last, id) > 20000 evict from mem where content is not null qualify evict")
def evict_over_bytes(spark, folder):
    rows = memories(spark, folder, "entity_id", "content", "importance").where("content is not null")
    return lifecycle.over_bytes(rows, 20_000, [F.col("importance").desc_nulls_last(), F.col("id")]).select("id", F.lit(True).alias("evict"))


@C.add(WITH + _VEC + "select id, round(case when nn > 0 and nn < 'infinity'::double then 1 - list_dot_product(e, (select q from q)) / (sqrt(nn) * (select sqrt(list_dot_product(q, q)) from q)) else 1 end, 6) distance, round(sqrt(nn), 6) norm from n where nn < 'infinity'::double")
def vector_math(spark, folder):
    from memlode.functions.columns import distance, normalised

    rows = memories(spark, folder, "embedding").where(F.size("embedding") == 64).withColumn("nn", dot(F.col("embedding"), F.col("embedding"))).where(F.col("nn") < float("inf"))
    unit = normalised(F.col("embedding"))
    query = query_vector(spark, folder)
    return rows.where(unit.isNull() | (F.size(unit) == 64)).select("id", F.round(distance(F.col("embedding"), query), 6).alias("distance"), F.round(F.sqrt("nn"), 6).alias("norm"))


@C.add(WITH + _VEC + "select id, round(sim, 6) similarity from s where visibility = 'global' or visibility = 'team' and team_id = 'team_a' or visibility = 'private' and agent_id = 'agent_1' order by round(sim, 9) desc, id limit 50")
def cosine_topk_visible(spark, folder):
    rows = memories(spark, folder, "embedding", "visibility", "team_id", "agent_id").where(filters.visible_to(filters.Viewer("agent_1", "team_a")))
    return search.similar(rows, query_vector(spark, folder), 50, least=-1.0).select("id", F.round("similarity", 6).alias("similarity"))


@C.add(WITH + _VEC + "select id, round(sim, 6) similarity from s join n using (id) where n.nn > 0 and n.nn < 'infinity'::double order by round(sim, 9) desc, id limit 50")
def index_topk(spark, folder):
    """The index with all cells probed gives the exact answer."""
    path = f"{own_dir(spark)}/index-{uuid.uuid4().hex}"
    index.build(memories(spark, folder, "embedding").where(F.size("embedding") == 64), "id", "embedding", path, cells=32)
    query = [float(v) for v in table(spark, folder, "embeddings").where("vec_id = 1").select("embedding").first()[0]]
    return index.search(spark, path, query, 50, probes=32).select("id", F.round("similarity", 6).alias("similarity"))


@C.add(WITH + ", x as (select entity_id, id, row_number() over (partition by entity_id order by importance desc nulls last, id) n from mem), y as (select entity_id, id, row_number() over (partition by entity_id order by created_at desc nulls last, id) n from mem) select x.entity_id query, round(count(y.id) / 5.0, 6) recall from x left join y on y.id = x.id and y.n <= 50 where x.n <= 5 and x.entity_id is not null group by 1")
def recall(spark, folder):
    rows = memories(spark, folder, "entity_id", "importance", "created_at").where("entity_id is not null")
    first = lambda order, n: rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col(order).desc_nulls_last(), "id"))).where(F.col("_n") <= n).select(F.col("entity_id").alias("query"), "id")
    return search.recall_at(first("created_at", 50), first("importance", 5), 5)


@C.add(WITH + "select id, round(0.6 * coalesce(confidence, 0) + 0.4 * coalesce(importance, 0), 6) score, round(least(greatest(importance * 1.7, 0), 1), 6) clamped from mem")
def reranked(spark, folder):
    from memlode.functions.columns import clamp

    rows = memories(spark, folder, "importance", "confidence")
    return rows.select("id", F.round(scoring.blended(F.coalesce("confidence", F.lit(0.0)), F.coalesce("importance", F.lit(0.0))), 6).alias("score"), F.round(clamp(F.col("importance") * 1.7, 0.0, 1.0), 6).alias("clamped"))


@C.add(WITH + ", p as (select id, content, lag(content) over (partition by entity_id order by id) b from mem where content is not null), w as (select id, list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '') x, list_filter(regexp_split_to_array(lower(b), '\\s+'), lambda w: w <> '') y from p where b is not null), r as (select id, list_filter(x, lambda v: not list_contains(y, lower(v))) r from w) select id, case when len(r) < 3 then '' else array_to_string(r, ' ') end words from r")
def unique_words(spark, folder):
    rows = memories(spark, folder, "entity_id", "content").where("content is not null").withColumn("b", F.lag("content").over(Window.partitionBy("entity_id").orderBy("id"))).where("b is not null")
    return rows.select("id", texts.unique_words(F.col("b"), F.col("content")).alias("words"))


@C.add(WITH + f", a as (select agent_id, content, count(*) n from mem where state <> 'deleted' group by all having count(*) > 1) select m.id from mem m join a using (agent_id, content) where m.state <> 'deleted'")
def content_lookup_agent(spark, folder):
    rows = memories(spark, folder, "agent_id", "content", "state").where("state <> 'deleted'").select("id", "agent_id", F.sha2("content", 256).alias("h"))
    asked = rows.groupBy("agent_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(asked, ["agent_id", "h"], "left_semi").select("id")


@C.add(WITH + _VEC + """, r as (select id, sim from s where state in ('active', 'resolved') and created_at >= timestamp '2023-12-01' and created_at <= timestamp '2024-01-20' and list_has_any(tags, ['work', 'family'])) select count(*) n from r""")
def retrieve_period(spark, folder):
    from datetime import datetime

    rows = memories(spark, folder, "embedding", "content", "importance", "confidence", "stability", "access_count", "created_at", "last_accessed_at", "state", "tags")
    return search.retrieve(rows, query_vector(spark, folder), NOW, 10_000_000, since=datetime(2023, 12, 1), until=datetime(2024, 1, 20), any_tags=("work", "family")).agg(F.count("*").alias("n"))


@C.add(WITH + ", g as (select entity_id, sha256(content) h, min(id) root from mem where state <> 'deleted' and content is not null group by 1, 2 having count(*) > 1), m as (select g.root, x.id from g join mem x on x.entity_id = g.entity_id and sha256(x.content) = g.h and x.state <> 'deleted'), t as (select distinct m.root, n.entity_id e from m join men n on n.memory_id = m.id)" + _EDGES + "select t.root, count(distinct t.e) entities, count(distinct edge.id) inner_edges from t left join edge on edge.a = t.e and edge.b in (select u.e from t u where u.root = t.root) group by 1")
def consolidation_context(spark, folder):
    rows = memories(spark, folder, "entity_id", "content", "state").where("state <> 'deleted' and content is not null").select("id", "entity_id", F.sha2("content", 256).alias("h"))
    roots = rows.groupBy("entity_id", "h").agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1").select("entity_id", "h", "root")
    members = rows.join(roots, ["entity_id", "h"]).select("id", "root")
    from memlode.operators import consolidate

    return consolidate.context(members, mentions(spark, folder, "memory_id", "entity_id"), _graph(spark, folder))


