"""Filters, paging, joins, statistics, lifecycle: named queries and their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import NOW, at
from memlode.operators import filters, lifecycle, scoring, stats
from memlode.plans.base import WITH, Catalog, entities, memories, mentions, messages, relationships, sql_days, surfaced
from memlode.sources.parquet import table

C = Catalog()
VIEWER, LONER = filters.Viewer("agent_1", "team_a"), filters.Viewer("agent_1")
HOT = "u0004711"  # the owner of most rows in the test tables

# ---- filters and paging


@C.add(WITH + f"select id, importance, state from mem where entity_id = '{HOT}' and memory_type in ('PLAN', 'ACTIVITY') and state in ('active', 'stale') and created_at <= timestamp '2024-01-15' and list_contains(tags, 'work')")
def memory_filter(spark, folder):
    fixed = (F.col("entity_id") == HOT) & (F.col("created_at") <= at(datetime(2024, 1, 15)))
    rows = memories(spark, folder, "entity_id", "memory_type", "state", "created_at", "tags", "importance", where=fixed)
    return filters.select_memories(rows, entity_id=HOT, types=("PLAN", "ACTIVITY"), states=("active", "stale"), tags=("work",), created_before=datetime(2024, 1, 15)).select("id", "importance", "state")


@C.add(WITH + "select id from mem where visibility = 'global' or visibility = 'team' and team_id = 'team_a' or visibility = 'private' and agent_id = 'agent_1'")
def visibility_team(spark, folder):
    return memories(spark, folder, "visibility", "team_id", "agent_id").where(filters.visible_to(VIEWER)).select("id")


@C.add(WITH + "select id from mem where visibility = 'global' or visibility = 'private' and agent_id = 'agent_1'")
def visibility_solo(spark, folder):
    return memories(spark, folder, "visibility", "team_id", "agent_id").where(filters.visible_to(LONER)).select("id")


@C.add(WITH + "select id from mem where list_contains(tags, 'family') and list_contains(tags, 'daily:09:00')")
def tags_all(spark, folder):
    return memories(spark, folder, "tags").where(filters.has_all_tags(("family", "daily:09:00"))).select("id")


@C.add(WITH + "select id from mem where list_has_any(tags, ['urgent', 'backlog'])")
def tags_any(spark, folder):
    return memories(spark, folder, "tags").where(filters.has_any_tag(("urgent", "backlog"))).select("id")


@C.add(WITH + "select id from mem where len(list_filter(tags, lambda t: starts_with(t, 'every:'))) > 0")
def tag_prefix(spark, folder):
    return memories(spark, folder, "tags").where(filters.has_tag_prefix("every:")).select("id")


@C.add(WITH + "select id from mem where contains(to_json(tags)::varchar, 'ly:')")
def tag_text(spark, folder):
    return memories(spark, folder, "tags").where(filters.has_tag_text("ly:")).select("id")


@C.add(WITH + "select count(*) n, count(distinct entity_id) owners from mem where created_at <= timestamp '2023-12-01'")
def asof_created(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "created_at", where=F.col("created_at") <= at(datetime(2023, 12, 1))), created_before=datetime(2023, 12, 1))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("owners"))


@C.add(WITH + "select id, created_at from mem where state = 'active' and created_at > timestamp '2024-01-25'")
def recent_hours(spark, folder):
    return filters.recent(memories(spark, folder, "state", "created_at", where=F.col("created_at") > at(NOW - timedelta(hours=168))), NOW, 168).select("id", "created_at")


@C.add(WITH + "select entity_id, count(*) n from mem where state = 'stale' group by 1")
def stale_rows(spark, folder):
    return memories(spark, folder, "entity_id", "state").where("state = 'stale'").groupBy("entity_id").agg(F.count("*").alias("n"))


@C.add(WITH + "select m.id from mem m semi join (select distinct sha256(content) h from msg) q on sha256(m.content) = q.h where m.state <> 'deleted'")
def content_lookup(spark, folder):
    rows = memories(spark, folder, "content", "state").where("state <> 'deleted'").withColumn("h", F.sha2("content", 256))
    return rows.join(messages(spark, folder).select(F.sha2("content", 256).alias("h")).distinct(), "h", "left_semi").select("id")


@C.add(WITH + "select id, content_hash is distinct from sha256(content) outdated from mem")
def hash_check(spark, folder):
    return memories(spark, folder, "content", "content_hash").select("id", (~F.col("content_hash").eqNullSafe(F.sha2("content", 256))).alias("outdated"))


@C.add(WITH + "select entity_id, count(*) n, min(created_at) oldest from mem where state in ('active', 'stale', 'resolved') group by 1")
def decay_rows(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "state", "created_at"), states=("active", "stale", "resolved"))
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@C.add(WITH + "select id from mem where coalesce(confidence, 0) = 0 or confidence >= 0.5")
def confidence_gate(spark, folder):
    return filters.confident(memories(spark, folder, "confidence"), 0.5).select("id")


@C.add(WITH + "select id from mem where id not in (select memory_id from sur where surfaced_at > timestamp '2024-01-30' and memory_id is not null)")
def surfaced_antijoin(spark, folder):
    return filters.not_surfaced(memories(spark, folder, "state"), surfaced(spark, folder), NOW, timedelta(hours=48)).select("id")


@C.add(
    WITH
    + """, marked as (select m.id, m.entity_id, s.k is not null shown from mem m left join (select distinct memory_id k from sur where surfaced_at > timestamp '2023-11-03') s on s.k = m.id)
select id from marked join (select entity_id, bool_or(not shown) fresh from marked group by 1) f using (entity_id) where not shown or not fresh"""
)
def surfaced_soft(spark, folder):
    return filters.prefer_not_surfaced(memories(spark, folder, "entity_id"), surfaced(spark, folder), NOW, timedelta(days=90)).select("id")


@C.add(WITH + "select id from mem where regexp_matches(trim(lower(content)), '^(monitoring |syncing |cleanup |standby|preparing summary|preparing planning|wrapping up|finalizing cleanup|keeping an eye on|watching |tracking progress on)')")
def meta_content(spark, folder):
    return memories(spark, folder, "content").where(filters.is_meta(F.col("content"))).select("id")


@C.add(WITH + "select id from mem where contains(content, '?') or regexp_matches(lower(content), '(^| )(how |what |why |when |where |who |which |can |does |is there |should )')")
def questions(spark, folder):
    return memories(spark, folder, "content").where(filters.is_question(F.col("content"))).select("id")


@C.add(WITH + r"select id, memory_id, coalesce(regexp_full_match(memory_id, '[a-zA-Z0-9_:.\-]+') and length(memory_id) <= 256, false) valid from men")
def id_validation(spark, folder):
    return mentions(spark, folder, "memory_id").select("id", "memory_id", filters.valid_id(F.col("memory_id")).alias("valid"))


@C.add(WITH + "select id from mem where coalesce(memory_type in ('IDENTITY', 'PREFERENCE', 'RELATIONSHIP', 'EVENT', 'ACTIVITY', 'PLAN', 'CONTEXT', 'EPHEMERAL') and importance between 0 and 1 and confidence between 0 and 1 and length(trim(content)) between 1 and 5000, false)")
def extraction_validation(spark, folder):
    ok = filters.valid_extraction(*[F.col(c) for c in ("memory_type", "importance", "confidence", "content")])
    return memories(spark, folder, "memory_type", "importance", "confidence", "content").where(ok).select("id")


@C.add(WITH + "select id, replace(replace(content, '<', '['), '>', ']') safe from msg")
def harmless_text(spark, folder):
    return messages(spark, folder).select("id", filters.harmless(F.col("content")).alias("safe"))


@C.add(WITH + "select id, importance from mem order by importance desc nulls last, id limit 50 offset 100")
def offset_page(spark, folder):
    return filters.page(memories(spark, folder, "importance"), "importance", limit=50, offset=100).select("id", "importance")


@C.add(WITH + "select m.id, m.created_at from mem m, (select created_at t, id i from mem where id = (select min(id) from mem)) c where m.created_at < c.t or m.created_at = c.t and m.id > c.i order by 2 desc, 1 limit 100")
def keyset_page(spark, folder):
    rows = memories(spark, folder, "created_at")
    first = rows.agg(F.min("id")).first()[0]
    return filters.page_after(rows, first).select("id", "created_at")


@C.add(WITH + f"select id, created_at from mem where entity_id = '{HOT}' and state in ('active', 'stale', 'resolved') order by created_at desc, id limit 100")
def list_memories(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "state", "created_at"), entity_id=HOT, states=("active", "stale", "resolved"))
    return filters.page(rows).select("id", "created_at")


@C.add(WITH + "select id, entity_id, created_at from (select *, row_number() over (partition by entity_id order by created_at desc, id) n from mem where state in ('active', 'stale', 'resolved')) where n <= 20 order by created_at desc, id limit 200")
def cross_entity_list(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "state", "created_at"), states=("active", "stale", "resolved"))
    return stats.first_of_each(rows, "entity_id", filters.ordering("created_at", True), 20, 200).select("id", "entity_id", "created_at")


@C.add(
    WITH
    + """, live as (select id, entity_id, importance, created_at from mem where state in ('active', 'stale')),
a as (select *, 'important' slice, row_number() over (partition by entity_id order by importance desc nulls last, id) n from live),
b as (select l.*, 'newest' slice, row_number() over (partition by l.entity_id order by l.created_at desc, l.id) n from live l anti join (select id from a where n <= 5) x using (id) where created_at > timestamp '2024-01-31')
select id, entity_id, slice from a where n <= 5 union all select id, entity_id, slice from b where n <= 5"""
)
def sample_strata(spark, folder):
    return stats.sample(filters.select_memories(memories(spark, folder, "entity_id", "state", "importance", "created_at"), states=("active", "stale")), NOW, 5).select("id", "entity_id", "slice")


@C.add()
def sample_random(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "state", "importance", "created_at"), states=("active", "stale"))
    return stats.sample(rows, NOW, 5, seed=7).select("id", "entity_id", "slice")


@C.add(WITH + "select entity_id, sha256(content) h, count(*) n, min(id) first_id from mem where state <> 'deleted' group by 1, 2 having count(*) > 1")
def exact_duplicates(spark, folder):
    rows = memories(spark, folder, "entity_id", "content", "state").where("state <> 'deleted'").select("id", "entity_id", F.sha2("content", 256).alias("h"))
    return rows.groupBy("entity_id", "h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@C.add(WITH + "select m.id, coalesce(t.team_id, '') team from mem m left join (select agent_id, min(team_id) team_id from mem where coalesce(team_id, '') <> '' group by 1) t using (agent_id)")
def team_resolve(spark, folder):
    rows = memories(spark, folder, "agent_id", "team_id")
    teams = rows.where(F.coalesce("team_id", F.lit("")) != "").groupBy("agent_id").agg(F.min("team_id").alias("team"))  # one row per agent
    return rows.join(teams, "agent_id", "left").select("id", F.coalesce("team", F.lit("")).alias("team"))


@C.add(WITH + "select n.id, e.canonical_name, e.type from men n join ent e on e.id = n.entity_id join mem m on m.id = n.memory_id where m.state = 'active'")
def mention_entities(spark, folder):
    live = memories(spark, folder, "state").where("state = 'active'").select(F.col("id").alias("memory_id"))
    said = mentions(spark, folder, "entity_id", "memory_id").join(live, "memory_id")
    return said.join(entities(spark, folder, "canonical_name", "type").withColumnRenamed("id", "entity_id"), "entity_id").select("id", "canonical_name", "type")


# ---- statistics

_STATS = "select memory_type, state, count(*) n, count(*) filter (deleted_at is null) undeleted from mem group by "


@C.add(WITH + _STATS + "1, 2")
def stats_by_type_state(spark, folder):
    return stats.by_type_and_state(memories(spark, folder, "memory_type", "state", "deleted_at"))


@C.add(WITH + _STATS + "rollup(memory_type, state)")
def stats_rollup(spark, folder):
    return stats.by_type_and_state(memories(spark, folder, "memory_type", "state", "deleted_at"), rollup=True)


@C.add(WITH + "select count(distinct entity_id) owners, count(*) filter (state <> 'deleted') memories, count(distinct entity_id) filter (state <> 'deleted') live_owners from mem")
def distinct_owners(spark, folder):
    return memories(spark, folder, "entity_id", "state").agg(F.countDistinct("entity_id").alias("owners"), F.count_if(F.col("state") != "deleted").alias("memories"), F.countDistinct(F.when(F.col("state") != "deleted", F.col("entity_id"))).alias("live_owners"))


@C.add(WITH + "select entity_id, count(*) filter (state = 'active') active, count(*) filter (state = 'stale') stale, count(*) filter (state = 'archived') archived, count(*) filter (state = 'deleted') deleted from mem group by 1")
def owner_stats(spark, folder):
    return stats.by_owner(memories(spark, folder, "entity_id", "state"))


@C.add(WITH + "select entity_id, sum(strlen(content))::bigint content_bytes, sum(coalesce(len(embedding), 0) * 4)::bigint vector_bytes from mem group by 1")
def storage_bytes(spark, folder):
    return stats.storage(memories(spark, folder, "entity_id", "content", "embedding"))


@C.add(WITH + "select agent_id, count(*) filter (state = 'active') active, count(*) filter (state = 'stale' and importance >= 0.8) decaying, count(*) filter (len(list_filter(confidence_factors, lambda f: starts_with(f, 'conflict_flagged:'))) > 0) conflicts from mem group by 1")
def attribution(spark, folder):
    return stats.attribution(memories(spark, folder, "agent_id", "state", "importance", "confidence_factors"))


@C.add(
    WITH
    + """, r as (select entity_id, sentiment, row_number() over (partition by entity_id order by created_at desc, id) n, least(count(*) over (partition by entity_id), 40) c from mem where state = 'active' and sentiment <> 0),
h as (select entity_id, any_value(c) n, avg(sentiment) filter (n <= c // 2) recent, avg(sentiment) filter (n > c // 2 and n <= c) earlier from r where n <= 40 group by 1 having count(*) >= 6)
select entity_id, n, round(recent, 6) recent, round(earlier, 6) earlier, case when recent - earlier > 0.3 then 'improving' when recent - earlier < -0.3 then 'declining' else 'stable' end trend from h"""
)
def sentiment_trend(spark, folder):
    return stats.sentiment_trend(memories(spark, folder, "entity_id", "state", "sentiment", "created_at"))


@C.add(WITH + "select relationship_type, round(sum(evidence_count / (1.0 + evidence_count)), 6) evidence_strength, sum(evidence_count)::bigint evidence, max(last_seen_at) last_seen from (select *, lower(trim(relationship_type)) t from rel) group by relationship_type")
def evidence_counts(spark, folder):
    rows = relationships(spark, folder, "relationship_type", "evidence_count", "last_seen_at")
    return rows.groupBy("relationship_type").agg(F.round(F.sum(F.col("evidence_count") / (F.lit(1.0) + F.col("evidence_count"))), 6).alias("evidence_strength"), F.sum("evidence_count").alias("evidence"), F.max("last_seen_at").alias("last_seen"))


# ---- lifecycle
_DECAY = f"exp(-coalesce({sql_days('last_accessed_at')}, 0) / (case when stability > 0 then stability else 60 end * (1 + 0.5 * ln(1 + greatest(coalesce(access_count, 0), 0)))))"
_BURST = f"case when access_count < 3 or last_accessed_at is null or {sql_days('last_accessed_at')} > 1 then 0.0::double else least(0.3::double, 0.015::double * access_count) end"
_LIFE = ("entity_id", "state", "memory_type", "importance", "confidence", "stability", "access_count", "last_accessed_at", "created_at", "updated_at", "tags", "deleted_at")


@C.add(WITH + f"select id, round({_DECAY}, 6) factor from mem")
def decay_factor(spark, folder):
    return memories(spark, folder, *_LIFE).select("id", F.round(scoring.decay_factor(NOW), 6).alias("factor"))


@C.add(WITH + f"select id, round({_BURST}, 6) boost from mem")
def burst_boost(spark, folder):
    return memories(spark, folder, *_LIFE).select("id", F.round(scoring.burst_boost(NOW), 6).alias("boost"))


@C.add(
    WITH
    + f"""select id, round(case when stability > 0 then stability else 60 end * case when coalesce({sql_days('last_accessed_at')}, 0) < 1 then 1.1 when {sql_days('last_accessed_at')} < 7 then 1.2 when {sql_days('last_accessed_at')} < 30 then 1.35 else 1.6 end
* (1 + least(0.15, 0.025 * ln(1 + access_count))), 6) grown from mem"""
)
def stability_growth(spark, folder):
    return memories(spark, folder, *_LIFE).select("id", F.round(scoring.grown_stability(NOW), 6).alias("grown"))


@C.add(WITH + "select id, round(stability * ln(2), 6) half_life, round(-stability * ln(0.3), 6) to_stale from mem")
def half_life(spark, folder):
    return memories(spark, folder, "stability").select("id", F.round(scoring.half_life(F.col("stability")), 6).alias("half_life"), F.round(scoring.days_to(F.col("stability"), 0.3), 6).alias("to_stale"))


@C.add(WITH + f"select id, round(1 / (1 + ln(1 + {sql_days('greatest(created_at, coalesce(last_accessed_at, created_at))')})), 6) recency from mem")
def recency_score(spark, folder):
    return memories(spark, folder, *_LIFE).select("id", F.round(scoring.recency(NOW), 6).alias("recency"))


@C.add(
    WITH
    + f""", f as (select id, state, least({_DECAY} + {_BURST}, 1) factor from mem where state in ('active', 'stale', 'resolved') and len(list_filter(tags, lambda t: regexp_matches(t, '^(cron:|hourly|daily|weekly|weekdays|monthly|every:|once:)'))) = 0),
n as (select *, case when factor >= 0.3 then 'active' when factor >= 0.1 then 'stale' when factor >= 0.01 then 'archived' else 'deleted' end s from f)
select id, state old_state, s new_state, round(factor, 6) factor from n where s <> state and not (state = 'resolved' and s in ('active', 'stale'))"""
)
def decay_transitions(spark, folder):
    return lifecycle.decay_transitions(memories(spark, folder, *_LIFE), NOW).select("id", "old_state", "new_state", F.round("factor", 6).alias("factor"))


@C.add(WITH + "select id from mem where state = 'stale' and updated_at < timestamp '2024-01-02'")
def archive_due(spark, folder):
    return lifecycle.archive_due(memories(spark, folder, "state", "updated_at"), NOW).select("id")


@C.add(WITH + "select id from mem where state = 'deleted' and deleted_at < timestamp '2023-11-03'")
def purge_due(spark, folder):
    return lifecycle.purge_due(memories(spark, folder, "state", "deleted_at"), NOW).select("id")


_EVICT = f"""greatest(coalesce(importance, 0), 0.01) * (1 + ln(1 + coalesce(access_count, 0)))
* case when {sql_days('last_accessed_at')} * 24 < 24 then 2.0 when {sql_days('last_accessed_at')} * 24 < 168 then 1.5 when {sql_days('last_accessed_at')} * 24 < 720 then 1.2 else 1.0 end
* case when created_at is null then 0.8 when {sql_days('created_at')} <= 30 then 1.0 else 1 / (1 + ln(greatest({sql_days('created_at')}, 30) / 30)) end"""


@C.add(WITH + f"select id, round({_EVICT}, 6) rank_value from mem")
def evict_rank(spark, folder):
    return memories(spark, folder, *_LIFE).select("id", F.round(scoring.eviction_rank(NOW), 6).alias("rank_value"))


@C.add(WITH + f", r as (select id, entity_id, round({_EVICT}, 9) v from mem where state in ('active', 'stale', 'resolved')) select id, entity_id from (select *, row_number() over (partition by entity_id order by v desc, id) n from r) where n > 100")
def evict_over_cap(spark, folder):
    rows = filters.select_memories(memories(spark, folder, *_LIFE), states=("active", "stale", "resolved"))
    return lifecycle.over_cap(rows, NOW, 100).select("id", "entity_id")


@C.add(WITH + "select id, entity_id, importance from (select *, row_number() over (partition by entity_id order by importance, id) n from mem where state in ('archived', 'stale')) where n <= 10")
def evict_candidates(spark, folder):
    rows = filters.select_memories(memories(spark, folder, "entity_id", "state", "importance"), states=("archived", "stale"))
    w = Window.partitionBy("entity_id").orderBy("importance", "id")
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 10").select("id", "entity_id", "importance")


# ---- commands: each returns the new version of what it changes


@C.add(WITH + "select id, sha256(content) content_hash, 'CONTEXT' memory_type, 0.5::double importance, 0.9::double confidence, 21.0::double stability, coalesce(nullif(agent_id, ''), 'default') agent_id, created_at last_accessed_at, 'active' state from msg where content is not null")
def seed_defaults(spark, folder):
    return lifecycle.seeded(messages(spark, folder)).select("id", "content_hash", "memory_type", "importance", "confidence", "stability", "agent_id", "last_accessed_at", "state")


@C.add(WITH + "select id, case when state = 'stale' then 'archived' else state end state, case when state = 'stale' then 0.1::double else importance end importance, case when state = 'stale' then timestamp '2024-02-01' else updated_at end updated_at, case when state = 'stale' then version + 1 else version end \"version\" from mem")
def partial_update(spark, folder):
    rows = memories(spark, folder, "state", "importance", "updated_at", "version")
    changes = rows.where("state = 'stale'").select("id", F.lit("archived").alias("state"), F.lit(0.1).alias("importance"))
    return lifecycle.updated(rows, changes, NOW)


@C.add(WITH + f"select id, case when entity_id = '{HOT}' then 'deleted' else state end state, case when entity_id = '{HOT}' then timestamp '2024-02-01' else deleted_at end deleted_at from mem")
def soft_delete(spark, folder):
    rows = memories(spark, folder, "entity_id", "state", "deleted_at")
    return lifecycle.soft_deleted(rows, rows.where(F.col("entity_id") == HOT).select("id"), NOW).select("id", "state", "deleted_at")


@C.add(WITH + f"select id from mem where entity_id is distinct from '{HOT}'")
def delete_owner(spark, folder):
    return memories(spark, folder, "entity_id").where(~F.col("entity_id").eqNullSafe(HOT)).select("id")


@C.add(WITH + "select m.id, m.access_count + h.n access_count, timestamp '2024-02-01' last_accessed_at from mem m join (select memory_id k, count(*)::int n from sur where memory_id is not null group by 1) h on h.k = m.id")
def reinforce(spark, folder):
    hits = surfaced(spark, folder).where("memory_id is not null").groupBy(F.col("memory_id").alias("id")).agg(F.count("*").cast("int").alias("hits"))
    return lifecycle.reinforced(memories(spark, folder, "access_count", "last_accessed_at", "stability"), hits, NOW).select("id", "access_count", "last_accessed_at")


@C.add(WITH + "select id, 'resolved' state, 0.1::double importance from mem where state = 'active' and memory_type = 'PLAN' and expires_at < timestamp '2024-02-01'")
def resolve_expired(spark, folder):
    rows = memories(spark, folder, "state", "memory_type", "expires_at")
    return rows.where((F.col("state") == "active") & (F.col("memory_type") == "PLAN") & (F.col("expires_at") < at(NOW))).select("id", F.lit("resolved").alias("state"), F.lit(0.1).alias("importance"))


@C.add(WITH + "select n.id, m.content from men n join mem m on m.id = n.memory_id")
def point_lookup(spark, folder):
    wanted = mentions(spark, folder, "memory_id").where("memory_id is not null")
    return wanted.join(memories(spark, folder, "content").withColumnRenamed("id", "memory_id"), "memory_id").select("id", "content")


@C.add("select count(*) n, count(distinct id) ids from memories")
def table_counts(spark, folder):
    return table(spark, folder, "memories").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
