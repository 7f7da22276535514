"""Commands of the write path as DataFrames: what is stored, replaced, resolved or archived, for all owners at once.

A command takes the current tables and a frame of requests and returns the rows to append or the new version of a
table; nothing is changed in place. Ids of new rows are derived from their content, so a command that runs twice
writes the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at

# Labels of extracted entities, and the types they are stored under.
ENTITY_TYPES = {"PERSON": "person", "ORGANIZATION": "organization", "LOCATION": "location", "PRODUCT": "product"}
# Types that complete something, types that wait for it, types whose importance is judged anew.
COMPLETING, WAITING, JUDGED = ("EVENT", "CONTEXT"), ("PLAN", "ACTIVITY"), ("IDENTITY", "PLAN", "RELATIONSHIP")


def entity_type(label: Column) -> Column:
    """The stored type of an extracted label, 'other' for any that is unknown or null."""
    out = F.lit("other")
    for said, kind in ENTITY_TYPES.items():
        out = F.when(label == said, kind).otherwise(out)
    return out


def new_id(prefix: str, *parts: Column) -> Column:
    """An id that depends on its parts only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def resolved_for_owner(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(owner, name, type, entity_id, how, confidence): each distinct name of an owner by exact name and type, else by alias or name without case, else new.

    ``found`` (owner, name, type); ``entities`` (id, owner_entity_id, canonical_name, type, aliases). Entities of
    other owners never match; the smallest id wins. Null owners or names are dropped.
    """
    asked = found.where("owner is not null and name is not null").select("owner", "name", "type", F.lower("name").alias("_key")).distinct()
    exact = entities.groupBy(F.col("owner_entity_id").alias("owner"), F.col("canonical_name").alias("name"), "type").agg(F.min("id").alias("_exact"))
    forms = F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name")), F.lower)))
    alias = entities.select("id", F.col("owner_entity_id").alias("owner"), forms.alias("_key")).groupBy("owner", "_key").agg(F.min("id").alias("_alias"))
    joined = asked.join(exact, ["owner", "name", "type"], "left").join(alias, ["owner", "_key"], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "alias").otherwise("new")
    return joined.select("owner", "name", "type", F.coalesce("_exact", "_alias", new_id("n", F.col("owner"), F.col("name"), F.col("type"))).alias("entity_id"), how.alias("how"), F.when(how == "exact", 1.0).when(how == "alias", 0.95).otherwise(0.0).alias("confidence"))


def resolved_by_vector(names: DataFrame, entities: DataFrame, least: float = 0.85, block: int = 2000) -> DataFrame:
    """(owner, name, entity_id, similarity): for names that neither name nor alias resolves, the owner's entity of the closest vector, if it is close enough.

    ``names`` (owner, name, vector), ``entities`` (id, owner_entity_id, vector). Ties go to the smallest id.
    """
    from memlode.operators.search import similarity_between

    left = names.select(F.col("name").alias("id"), F.col("owner").alias("_owner"), F.col("vector").alias("embedding"))
    right = entities.select("id", F.col("owner_entity_id").alias("_owner"), F.col("vector").alias("embedding"))
    near = similarity_between(left, right, "_owner", least, top=1, block=block)
    return near.select(F.col("group").alias("owner"), F.col("a").alias("name"), F.col("b").alias("entity_id"), "similarity")


def stored_mentions(found: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new entities, mentions) that extraction adds.

    ``found`` (owner, memory_id, name, type, snippet, confidence). New entities come out once per owner, name and
    type; mentions once per memory and entity, with the surest evidence.
    """
    names = resolved_for_owner(found, entities)
    fresh = names.where("how = 'new'").select(F.col("entity_id").alias("id"), F.col("owner").alias("owner_entity_id"), F.col("name").alias("canonical_name"), "type")
    said = found.join(names.select("owner", "name", "type", "entity_id"), ["owner", "name", "type"])
    best = said.groupBy("memory_id", "entity_id").agg(F.max(F.struct("confidence", F.col("name").alias("mention_text"), F.col("snippet").alias("context_snippet"))).alias("b"))
    return fresh, best.select(new_id("x", F.col("memory_id"), F.col("entity_id")).alias("id"), "memory_id", "entity_id", "b.mention_text", "b.context_snippet", "b.confidence")


def stored_relationships(found: DataFrame, entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships changed or new, evidence) for detected relations whose ends are both known to the owner.

    ``found`` (owner, memory_id, source, target, kind, confidence, evidence) with names. A relation that exists takes
    the mean of its strength and the surest new confidence if that is greater, and counts its evidence; else it is
    new with the confidence as strength. Several new rows of one relation act as one.
    """
    alias = entities.select("id", F.col("owner_entity_id").alias("owner"), F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("canonical_name")), F.lower))).alias("k"))
    alias = alias.groupBy("owner", "k").agg(F.min("id").alias("id"))
    ends = [alias.select("owner", F.col("k").alias(f"_{x}"), F.col("id").alias(f"{x}_entity_id")) for x in ("source", "target")]
    known = found.withColumns({"_source": F.lower("source"), "_target": F.lower("target")}).join(ends[0], ["owner", "_source"]).join(ends[1], ["owner", "_target"]).where("source_entity_id <> target_entity_id")
    summed = known.groupBy("owner", "source_entity_id", "target_entity_id", "kind").agg(F.max("confidence").alias("_new"), F.count("*").alias("_more"))
    old = relationships.select(F.col("id").alias("_id"), F.col("owner_entity_id").alias("owner"), "source_entity_id", "target_entity_id", F.col("relationship_type").alias("kind"), F.col("strength").alias("_old"), F.col("evidence_count").alias("_count"))
    first = old.groupBy("owner", "source_entity_id", "target_entity_id", "kind").agg(F.min(F.struct("_id", "_old", "_count")).alias("o"))
    key = ["owner", "source_entity_id", "target_entity_id", "kind"]
    joined = summed.join(first, key, "left")
    strength = F.when(F.col("o").isNull(), F.col("_new")).when(F.col("_new") > F.col("o._old"), (F.col("o._old") + F.col("_new")) / 2).otherwise(F.col("o._old"))
    made = joined.select(F.coalesce("o._id", new_id("r", *[F.col(k) for k in key])).alias("id"), *key, strength.alias("strength"), (F.coalesce("o._count", F.lit(0)) + F.col("_more")).cast("bigint").alias("evidence_count"), F.col("o").isNull().alias("is_new"))
    evidence = known.join(made.select("id", *key), key).select(F.col("id").alias("relationship_id"), "memory_id", "evidence", "confidence")
    return made, evidence


def evidence_added(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relationships with the count and last time of new evidence (relationship_id, seen_at) added."""
    counted = evidence.groupBy(F.col("relationship_id").alias("id")).agg(F.count("*").alias("_n"), F.max("seen_at").alias("_last"))
    joined = relationships.join(counted, "id", "left")
    return joined.withColumn("evidence_count", F.col("evidence_count") + F.coalesce("_n", F.lit(0))).withColumn("last_seen_at", F.greatest("last_seen_at", "_last")).drop("_n", "_last")


def without_owner(tables: dict[str, DataFrame], owner: str, columns: dict[str, str]) -> dict[str, DataFrame]:
    """New versions of tables without the rows of an owner; ``columns``: where each table names its owner."""
    return {name: df.where(~F.col(columns[name]).eqNullSafe(F.lit(owner))) for name, df in tables.items()}


# ---- conflicts


def conflict_resolved(pairs: DataFrame) -> DataFrame:
    """(id, content, operation): what the old memory of each pair (old_id, old, new, resolution, merged) becomes; 'keep', 'both' and 'ask' change nothing.

    'use_new' takes the new text; 'merge' the merged one, or if there is none the old with the new as an update.
    Several conflicts of one memory: the one of the greatest new text holds.
    """
    text = F.when(F.col("resolution") == "use_new", F.col("new")).when(F.col("resolution") == "merge", F.coalesce(F.nullif("merged", F.lit("")), F.concat("old", F.lit(" (Updated: "), "new", F.lit(")"))))
    changed = pairs.select(F.col("old_id").alias("id"), text.alias("content"), F.when(F.col("resolution") == "merge", "conflict_merge").otherwise("conflict_resolution").alias("operation")).where("content is not null")
    return changed.groupBy("id").agg(F.max(F.struct("content", "operation")).alias("m")).select("id", "m.content", "m.operation")


def superseded(near: DataFrame, memories: DataFrame, created: DataFrame) -> DataFrame:
    """(id, by): active plans and activities that a newly created event or context resolves.

    ``near`` (a, b): pairs of one owner at the similarity that resolves (0.70), a from ``created`` (id); the smallest
    resolving id is named.
    """
    done = memories.where(F.col("memory_type").isin(*COMPLETING)).join(created.select("id"), "id", "left_semi").select(F.col("id").alias("a"))
    open_ = memories.where(F.col("memory_type").isin(*WAITING) & (F.col("state") == "active")).join(created.select("id"), "id", "left_anti").select(F.col("id").alias("b"))
    return near.join(done, "a", "left_semi").join(open_, "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("by"))


def to_judge_anew(near: DataFrame, memories: DataFrame, low: float = 0.5, high: float = 0.85, least: float = 0.5) -> DataFrame:
    """(new_id, id, similarity): stored memories whose importance a new one may change: neither the same fact nor unrelated, of a type that lasts, important already."""
    kept = memories.where(F.col("memory_type").isin(*JUDGED) & (F.col("importance") > least)).select(F.col("id").alias("b"))
    return near.where(F.col("similarity").between(low, high)).join(kept, "b", "left_semi").select(F.col("a").alias("new_id"), F.col("b").alias("id"), "similarity")


# ---- schedules


def has_cron(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.startswith("cron:")), F.lit(False))


def same_schedule(a: Column, b: Column) -> Column:
    """Texts of two schedules are one: equal without case and blanks around, or one holds the other."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | x.contains(y) | y.contains(x)


def schedules_replaced(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, request_id): active schedules that new ones of the same owner and agent replace.

    ``requests`` (request_id, entity_id, agent_id, content). Only schedules are joined, so an owner brings few rows.
    """
    old = memories.where((F.col("state") == "active") & has_cron(F.col("tags"))).select("id", "entity_id", "agent_id", F.col("content").alias("_old"))
    return old.join(requests, ["entity_id", "agent_id"]).where(same_schedule(F.col("_old"), F.col("content"))).groupBy("id").agg(F.min("request_id").alias("request_id"))


def schedules_created(requests: DataFrame, teams: DataFrame, now: datetime) -> DataFrame:
    """Memories of new schedules (request_id, entity_id, agent_id, content, cron_tag), visible to the agent's team if it has one. ``teams`` (agent_id, team_id)."""
    joined = requests.join(teams, "agent_id", "left")
    seen = F.when(F.coalesce("team_id", F.lit("")) != "", "team").otherwise("private")
    return joined.select(
        new_id("s", F.col("request_id")).alias("id"), "entity_id", "agent_id", F.coalesce("team_id", F.lit("")).alias("team_id"), seen.alias("visibility"), "content", F.sha2("content", 256).alias("content_hash"),
        F.lit("PLAN").alias("memory_type"), F.array("cron_tag").alias("tags"), F.lit(0.9).alias("importance"), F.lit(1.0).alias("confidence"), F.lit(365.0).alias("stability"), F.lit("active").alias("state"), F.lit("schedule_api").alias("source"), at(now).alias("created_at"),
    )


def schedules_updated(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Schedules with another cron tag and perhaps text: ``changes`` (id, cron_tag, content or null). Other tags stay, the schedule is active again; memories that are no schedule don't come out."""
    joined = memories.where(has_cron(F.col("tags"))).join(changes.select("id", "cron_tag", F.col("content").alias("_new")), "id")
    tags = F.array_append(F.filter("tags", lambda t: ~t.startswith("cron:")), F.col("cron_tag"))
    return joined.select("id", tags.alias("tags"), F.coalesce("_new", "content").alias("content"), F.lit("active").alias("state"))


def schedules_cancelled(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.where(has_cron(F.col("tags"))).join(ids.select("id"), "id", "left_semi").select("id", F.lit("archived").alias("state"))


def schedules_acknowledged(memories: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Schedules that ran: one access more, now; one that runs once is archived."""
    from memlode.operators import schedule

    rows = schedule.planned(memories.join(ids.select("id"), "id", "left_semi"), F.coalesce("last_accessed_at", "created_at")).where("s_kind is not null")
    state = F.when(F.col("s_kind") == "once", "archived").otherwise(F.col("state"))
    return rows.select("id", (F.col("access_count") + 1).alias("access_count"), at(now).alias("last_accessed_at"), state.alias("state"))


def schedules_listed(memories: DataFrame) -> DataFrame:
    """All schedules that are active or went stale by mistake; the latter come out as active, marked ``recovered``."""
    rows = memories.where(has_cron(F.col("tags")) & F.col("state").isin("active", "stale"))
    return rows.withColumn("recovered", F.col("state") == "stale").withColumn("state", F.lit("active"))


# ---- histories


def changes_of(versions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, version number, column, old, new): what changed from one version of a record to the next, newest last; equal copies of a version count once."""
    distinct = versions.select(key, *order, *columns).where(F.col(key).isNotNull()).distinct()
    w = Window.partitionBy(key).orderBy(*order, *columns)
    numbered = distinct.withColumn("number", F.row_number().over(w))
    parts = [F.struct(F.lit(c).alias("column"), F.lag(F.col(c).cast("string")).over(w).alias("old"), F.col(c).cast("string").alias("new")) for c in columns]
    flat = numbered.withColumn("_c", F.array(*parts)).where("number > 1").select(key, "number", F.inline("_c"))
    return flat.where(~F.col("old").eqNullSafe(F.col("new")))


def latest_states(history: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """(key, state, changes, since): the state each machine is in; entries that change nothing are not stored, and don't count."""
    w = Window.partitionBy(*key).orderBy(*order)
    moved = history.withColumn("_before", F.lag(state).over(w)).where(~F.col("_before").eqNullSafe(F.col(state)))
    last = F.max(F.struct(*order, F.col(state).alias("_s"))).alias("_last")
    return moved.groupBy(*key).agg(last, F.count("*").alias("changes")).select(*key, F.col("_last._s").alias("state"), "changes", F.col(f"_last.{order[0]}").alias("since"))


def team_members(assignments: DataFrame) -> DataFrame:
    """(agent_id, team_id): the team each agent was last put in; an agent is in one team at most, a blank team takes it out. ``assignments`` (agent_id, team_id, assigned_at)."""
    last = assignments.where("agent_id is not null").groupBy("agent_id").agg(F.max(F.struct("assigned_at", F.coalesce("team_id", F.lit("")).alias("t"))).alias("m"))
    return last.select("agent_id", F.col("m.t").alias("team_id")).where("team_id <> ''")
