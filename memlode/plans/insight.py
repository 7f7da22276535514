"""Graph and signals: named queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlode.functions.columns import NOW
from memlode.operators import graph, signals
from memlode.plans.base import WITH, Catalog, entities, memories, mentions, relationships, surfaced
from memlode.plans.search import _VPAIRS
from memlode.sources.parquet import clean_key

C = Catalog()
_KEY = r"nullif(lower(regexp_replace({}, '^[\s\x{{200B}}\x{{FEFF}}]+|[\s\x{{200B}}\x{{FEFF}}]+$', '', 'g')), '')"
_EDGES = f""", raw as (select id, {_KEY.format('source_entity_id')} s, {_KEY.format('target_entity_id')} t, regexp_replace(lower(trim(relationship_type)), '[\\s-]+', '_', 'g') kind, strength from rel where strength >= 0.3),
sound as (select * from raw where s in (select id from ent) and t in (select id from ent) and s <> t),
edge as (select id, s a, t b, kind, strength from sound union all select id, t, s, kind, strength from sound)
"""
_REL = ("source_entity_id", "target_entity_id", "relationship_type", "strength")


def _graph(spark, folder):
    return graph.edges(relationships(spark, folder, *_REL), entities(spark, folder, "type"))


@C.add(WITH + _EDGES + "select * from edge")
def edges(spark, folder):
    return _graph(spark, folder)


@C.add(WITH + _EDGES + "select a, count(distinct b) neighbours, max(strength) best from edge group by 1")
def neighbors(spark, folder):
    return graph.neighbours(_graph(spark, folder))


@C.add("with recursive " + (WITH + _EDGES).strip().removeprefix("with ") + ", root as (select min(id) id from ent where owner_entity_id = 'u0004711'), walk as (select (select id from root) root, (select id from root) node, 0 depth union select root, b, depth + 1 from walk join edge on a = node where depth < 4) select root, node, min(depth) depth from walk group by 1, 2")
def bfs(spark, folder):
    root = entities(spark, folder, "owner_entity_id").where("owner_entity_id = 'u0004711'").agg(F.min("id").alias("id"))
    return graph.reached(_graph(spark, folder), root, 4)


@C.add("with recursive " + (WITH + _EDGES).strip().removeprefix("with ") + ", pairs as (select min(id) source, max(id) target from ent group by owner_entity_id having count(*) > 1), walk as (select distinct source root, source node, 0 hops from pairs union select root, b, hops + 1 from walk join edge on a = node where hops < 3) select source, target, min(hops) hops from pairs left join walk on root = source and node = target group by 1, 2")
def shortest_hops(spark, folder):
    pairs = entities(spark, folder, "owner_entity_id").groupBy("owner_entity_id").agg(F.min("id").alias("source"), F.max("id").alias("target")).where("source <> target").select("source", "target")
    return graph.hops(_graph(spark, folder), pairs, 3)


@C.add(WITH + "select id, round(0.4 * (1 - 1 / (1.0 + evidence_count)) + 0.3 * (1 / (1 + ln(1 + greatest((epoch_us(timestamp '2024-02-01') - epoch_us(last_seen_at)) / 86400000000.0, 0)))) + 0.3 * confidence, 6) strength from rel")
def edge_strength(spark, folder):
    from memlode.functions.columns import days_until

    rows = relationships(spark, folder, "evidence_count", "last_seen_at", "confidence")
    recency = 1 / (1 + F.log1p(days_until("last_seen_at", NOW)))
    return rows.select("id", F.round(graph.strength(F.col("evidence_count").cast("double"), recency, F.col("confidence")), 6).alias("strength"))


@C.add(WITH + """, n as (select distinct mention_text "name" from men where mention_text is not null), x as (select canonical_name k, min(id) i from ent group by 1), a as (select lower(u) k, min(id) i from (select id, unnest(aliases) u from ent) group by 1)
select n."name", coalesce(x.i, a.i) entity_id, case when x.i is not null then 'exact' when a.i is not null then 'alias' else 'new' end how, case when x.i is not null then 1.0 when a.i is not null then 0.95 else 0.0 end::double confidence from n left join x on x.k = n."name" left join a on a.k = lower(n."name")""")
def alias_lookup(spark, folder):
    names = mentions(spark, folder, "mention_text").where("mention_text is not null").select(F.col("mention_text").alias("name"))
    return graph.resolved(names, entities(spark, folder, "canonical_name", "aliases"))


@C.add(WITH + "select id, owner_entity_id, mention_count from (select *, row_number() over (partition by owner_entity_id order by mention_count desc nulls last, id) n from ent) where n <= 10")
def entity_rank(spark, folder):
    from pyspark.sql.window import Window

    w = Window.partitionBy("owner_entity_id").orderBy(F.col("mention_count").desc_nulls_last(), "id")
    return entities(spark, folder, "owner_entity_id", "mention_count").withColumn("n", F.row_number().over(w)).where("n <= 10").select("id", "owner_entity_id", "mention_count")


@C.add(WITH + f", m as (select id, {_KEY.format('memory_id')} k, entity_id from men) select o.owner_entity_id, count(*) mentions, count(distinct m.k) memories from m join ent o on o.id = m.entity_id join mem on mem.id = m.k group by 1")
def owner_mentions(spark, folder):
    said = mentions(spark, folder, "memory_id", "entity_id").withColumn("memory_id", clean_key(F.col("memory_id")))
    owners = entities(spark, folder, "owner_entity_id").withColumnRenamed("id", "entity_id")
    live = memories(spark, folder, "state").select(F.col("id").alias("memory_id"))
    return said.join(live, "memory_id").join(owners, "entity_id").groupBy("owner_entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("memory_id").alias("memories"))


@C.add()
def text_relations(spark, folder):
    return graph.relations(memories(spark, folder, "content"))


@C.add(WITH + f""", m as (select distinct {_KEY.format('n.memory_id')} k, n.entity_id e, n.mention_text t from men n), p as (select m.k, m.e, strpos(content, t) s, strpos(content, t) + length(t) f from m join mem on mem.id = m.k where strpos(content, t) > 0)
select a.k memory_id, a.e a, b.e b, min(greatest(b.s - a.f, a.s - b.f, 0))::int distance from p a join p b on a.k = b.k and a.e < b.e group by 1, 2, 3 having min(greatest(b.s - a.f, a.s - b.f, 0)) < 100""")
def cooccurrence(spark, folder):
    said = mentions(spark, folder, "memory_id", "entity_id", "mention_text").withColumn("memory_id", clean_key(F.col("memory_id"))).select("memory_id", "entity_id", "mention_text").distinct()
    return graph.cooccurring(said, memories(spark, folder, "content"))


@C.add(WITH + f", t as (select distinct {_KEY.format('memory_id')} id, entity_id from men) select m.id, list_sort(list(t.entity_id)) topics from mem m join t using (id) where m.state = 'active' group by 1")
def signal_topics(spark, folder):
    said = mentions(spark, folder, "memory_id", "entity_id").select(clean_key(F.col("memory_id")).alias("id"), "entity_id").distinct()
    return memories(spark, folder, "state").where("state = 'active'").join(said, "id").groupBy("id").agg(F.array_sort(F.collect_list("entity_id")).alias("topics"))


# ---- signals
_COLS = ("entity_id", "memory_type", "state", "importance", "confidence", "tags", "content", "created_at", "updated_at", "last_accessed_at", "expires_at", "stability", "confidence_factors")
_SCHEDULED = "len(list_filter(tags, lambda t: regexp_matches(t, '^(cron:|hourly|daily|weekly|weekdays|monthly|every:|once:)'))) > 0"
_META = "regexp_matches(trim(lower(content)), '^(monitoring |syncing |cleanup |standby|preparing summary|preparing planning|wrapping up|finalizing cleanup|keeping an eye on|watching |tracking progress on)')"
_Q = "(contains(content, '?') or regexp_matches(lower(content), '(^| )(how |what |why |when |where |who |which |can |does |is there |should )'))"
_PEND = f"select id, entity_id, stability from (select *, row_number() over (partition by entity_id order by importance desc nulls last, id) n from mem where memory_type in ('PLAN', 'ACTIVITY') and state = 'active') where n <= 20 and importance >= 0.4 and not {_SCHEDULED} and not {_META} and (updated_at is null or updated_at > timestamp '2024-01-25' or coalesce(expires_at > timestamp '2024-02-01' and expires_at < timestamp '2024-02-15', false))"
_DEAD = "select id, entity_id, stability from (select *, row_number() over (partition by entity_id order by importance desc nulls last, id) n from mem where state = 'active') where n <= 100 and expires_at < timestamp '2024-02-02'"
_DECAYING = "select id, entity_id, stability from mem where state = 'stale' and importance >= 0.8"


@C.add(WITH + f"select id, entity_id from ({_PEND})")
def sig_pending(spark, folder):
    return signals.pending(memories(spark, folder, *_COLS), NOW).select("id", "entity_id")


@C.add(WITH + f"select id, entity_id from ({_DEAD})")
def sig_deadlines(spark, folder):
    return signals.deadlines(memories(spark, folder, *_COLS), NOW).select("id", "entity_id")


@C.add()
def sig_scheduled(spark, folder):
    return signals.scheduled(memories(spark, folder, *_COLS), surfaced(spark, folder), NOW).select("id", "entity_id", "missed")


@C.add(WITH + f"select id, entity_id from ({_DECAYING})")
def sig_decaying(spark, folder):
    return signals.decaying(memories(spark, folder, *_COLS)).select("id", "entity_id")


@C.add(WITH + "select id, entity_id from mem where len(list_filter(confidence_factors, lambda f: starts_with(f, 'conflict_flagged:'))) > 0")
def sig_conflicts(spark, folder):
    return signals.flagged(memories(spark, folder, *_COLS)).select("id", "entity_id")


@C.add(WITH + "select id, entity_id from mem where memory_type = 'PLAN' and state = 'active' and list_contains(tags, 'monitor') and coalesce(last_accessed_at, created_at) < timestamp '2024-01-31'")
def sig_stale(spark, folder):
    return signals.stale_monitors(memories(spark, folder, *_COLS), NOW).select("id", "entity_id")


@C.add(WITH + ", r as (select *, row_number() over (partition by entity_id order by created_at desc, id) n, max(created_at) over (partition by entity_id) newest from mem where memory_type in ('CONTEXT', 'ACTIVITY') and state = 'active') select entity_id, count(*) filter (memory_type = 'ACTIVITY') unfinished, max(newest) newest_at from r where n <= 5 and newest - created_at <= interval 2 hour group by 1 having count(*) filter (memory_type = 'ACTIVITY') > 0 and max(newest) > timestamp '2024-01-31 12:00:00'")
def sig_continuity(spark, folder):
    return signals.continuity(memories(spark, folder, *_COLS), NOW)


_NEAR = _VPAIRS + ", near as (select a, b from p where c >= 0.4 - 1e-9)"


@C.add(WITH + _NEAR + """, plans as (select * from (select *, row_number() over (partition by entity_id order by importance desc nulls last, id) n from mem where memory_type = 'PLAN' and state = 'active') where n <= 20),
close as (select l.id, m.created_at, row_number() over (partition by l.id order by round(c, 9) desc, l.o) r from (select a id, b o, c from p where c >= 0.4 - 1e-9 union all select b, a, c from p where c >= 0.4 - 1e-9) l join plans using (id) join mem m on m.id = l.o and m.memory_type = 'ACTIVITY' and m.state = 'active'),
acts as (select id, count(*) activities, count(*) filter (created_at > timestamp '2024-01-25') recent from close where r <= 20 group by 1)
select id, entity_id, coalesce(activities, 0) activities, least(1, coalesce(activities, 0) / 10.0)::double progress, case when activities is null then 'no_activity' when recent > 0 then 'on_track' when expires_at >= timestamp '2024-02-01' and expires_at < timestamp '2024-02-15' then 'at_risk' else 'stalled' end status from plans left join acts using (id)""")
def sig_goals(spark, folder):
    rows = memories(spark, folder, *_COLS, "embedding")
    return signals.goals(rows.withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding"))), NOW)


@C.add(WITH + ", l as (select entity_id id, max(created_at) t from men group by 1) select id, owner_entity_id as \"owner\", floor((epoch_us(timestamp '2024-02-01') - epoch_us(t)) / 86400000000.0)::int days_silent from ent join l using (id) where greatest(epoch_us(timestamp '2024-02-01') - epoch_us(t), 0) >= 7 * 86400000000")
def sig_silence(spark, folder):
    return signals.silence(entities(spark, folder, "owner_entity_id"), mentions(spark, folder, "entity_id", "created_at"), NOW)


@C.add(WITH + _NEAR + f", asked as (select *, row_number() over (partition by entity_id order by created_at desc, id) n from mem where state = 'active'), g as (select *, row_number() over (partition by entity_id order by created_at desc, id) k from asked where n <= 50 and {_Q} and id not in (select a from p where c >= 0.6 - 1e-9 union select b from p where c >= 0.6 - 1e-9)) select id, entity_id from g where k <= 5")
def sig_gaps(spark, folder):
    rows = memories(spark, folder, *_COLS, "embedding")
    return signals.gaps(rows.withColumn("embedding", F.when(F.size("embedding") == 64, F.col("embedding")))).select("id", "entity_id")


def _signals(spark, folder):
    rows = memories(spark, folder, *_COLS)
    named = (("pending", signals.pending(rows, NOW)), ("deadlines", signals.deadlines(rows, NOW)), ("decaying", signals.decaying(rows)))
    parts = [df.select("entity_id", F.lit(name).alias("signal"), "id", "stability") for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ALL = f", sig as (select entity_id, 'pending' signal, id, stability from ({_PEND}) union all select entity_id, 'deadlines', id, stability from ({_DEAD}) union all select entity_id, 'decaying', id, stability from ({_DECAYING}))"


@C.add(WITH + _ALL + ", m as (select entity_id, signal, avg(stability) s from sig group by 1, 2) select entity_id, sum(floor(case signal when 'pending' then 3 when 'deadlines' then 10 else 1 end * (0.5::double + s / 365) + 0.5))::bigint score from m group by 1")
def confluence(spark, folder):
    return signals.confluence(_signals(spark, folder), 365.0)


@C.add(WITH + _ALL + ", p as (select distinct entity_id, signal || ':' || id p from sig) select entity_id, substr(sha256(string_agg(p, '|' order by p)), 1, 16) fingerprint from p group by 1")
def fingerprint(spark, folder):
    return signals.fingerprint(_signals(spark, folder))
