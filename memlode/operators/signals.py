"""Signals per owner: what is pending, due, decaying, in conflict, stalled, silent or unanswered at a moment.

Every signal is a query over all owners at once: a cut to the first rows of each owner is a window that keeps
those rows per task before the shuffle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at, days_until, micros, round_half_up
from memlode.operators import filters, schedule, search
from memlode.operators.lifecycle import is_scheduled

# Urgency of each signal, and weights of the urgencies.
TIERS = {"scheduled": "immediate", "deadlines": "immediate", "conflicts": "elevated", "continuity": "elevated", "stale": "elevated", "pending": "normal", "goals": "normal", "gaps": "normal", "decaying": "low", "sentiment": "low", "silence": "low", "patterns": "low"}
WEIGHTS = {"immediate": 10, "elevated": 5, "normal": 3, "low": 1}


def _top(rows: DataFrame, each: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(*order, F.col("id").asc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")


def pending(memories: DataFrame, now: datetime, floor: float = 0.4, each: int = 20) -> DataFrame:
    """The most important plans and activities that are recent or due soon; the cut comes before the conditions."""
    rows = filters.select_memories(memories, types=("PLAN", "ACTIVITY"), states=("active",))
    top = _top(rows, each, F.col("importance").desc_nulls_last())
    soon = (F.col("expires_at") > at(now)) & (F.col("expires_at") < at(now + timedelta(days=14)))
    recent = F.col("updated_at").isNull() | (F.col("updated_at") > at(now - timedelta(days=7)))
    return top.where((F.col("importance") >= floor) & ~is_scheduled(F.col("tags")) & ~filters.is_meta(F.col("content")) & (recent | F.coalesce(soon, F.lit(False))))


def deadlines(memories: DataFrame, now: datetime, window: timedelta = timedelta(hours=24), each: int = 100) -> DataFrame:
    return _top(memories.where("state = 'active'"), each, F.col("importance").desc_nulls_last()).where(F.col("expires_at") < at(now + window))


def scheduled(memories: DataFrame, surfaced: DataFrame, now: datetime, each: int = 100) -> DataFrame:
    """Due schedules that weren't shown within half an hour, with whether their window was missed."""
    top = _top(memories.where("state = 'active'"), each, F.col("created_at").desc())
    rows = schedule.planned(top, F.coalesce("last_accessed_at", "created_at"))
    due = rows.where(schedule.due(F.col("next_at"), now)).withColumn("missed", schedule.missed(F.col("next_at"), now)).drop("s_kind", "s_seconds", "next_at")
    return filters.not_surfaced(due, surfaced, now, timedelta(minutes=30))


def decaying(memories: DataFrame) -> DataFrame:
    return memories.where((F.col("state") == "stale") & (F.col("importance") >= 0.8))


def flagged(memories: DataFrame) -> DataFrame:
    return memories.where(F.coalesce(F.exists("confidence_factors", lambda f: f.startswith("conflict_flagged:")), F.lit(False)))


def stale_monitors(memories: DataFrame, now: datetime) -> DataFrame:
    rows = memories.where((F.col("memory_type") == "PLAN") & (F.col("state") == "active") & filters.has_all_tags(["monitor"]))
    return rows.where(F.coalesce("last_accessed_at", "created_at") < at(now - timedelta(hours=24)))


def continuity(memories: DataFrame, now: datetime, window: timedelta = timedelta(hours=2), fresh: timedelta = timedelta(hours=12)) -> DataFrame:
    """Owners whose newest session is fresh and holds unfinished work: (entity_id, unfinished, newest_at)."""
    rows = filters.select_memories(memories, types=("CONTEXT", "ACTIVITY"), states=("active",))
    top = _top(rows, 5, F.col("created_at").desc()).withColumn("_newest", F.max("created_at").over(Window.partitionBy("entity_id")))
    same = top.where(micros("_newest") - micros("created_at") <= int(window.total_seconds() * 1e6))
    out = same.groupBy("entity_id").agg(F.count_if(F.col("memory_type") == "ACTIVITY").alias("unfinished"), F.max("_newest").alias("newest_at"))
    return out.where((F.col("unfinished") > 0) & (F.col("newest_at") > at(now - fresh)))


def goals(memories: DataFrame, now: datetime, each: int = 20, near: float = 0.4, top: int = 20) -> DataFrame:
    """Progress of each owner's ``each`` most important plans from the ``top`` activities close to each; only these two sides are compared."""
    plans = _top(filters.select_memories(memories, types=("PLAN",), states=("active",)), each, F.col("importance").desc_nulls_last()).select("id", "entity_id", "expires_at", "embedding")
    acts = filters.select_memories(memories, types=("ACTIVITY",), states=("active",)).select("id", "entity_id", "embedding", "created_at")
    close = search.similarity_between(plans, acts, "entity_id", near, top=top).join(acts.select(F.col("id").alias("b"), F.col("created_at").alias("acted")), "b")
    counted = close.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("activities"), F.count_if(F.col("acted") > at(now - timedelta(days=7))).alias("recent"))
    left = (micros("expires_at") - micros(at(now))) / 86_400_000_000.0
    status = F.when(F.col("activities").isNull(), "no_activity").when(F.col("recent") > 0, "on_track").when((left >= 0) & (left < 14), "at_risk").otherwise("stalled")
    return plans.join(counted, "id", "left").select("id", "entity_id", F.coalesce("activities", F.lit(0)).alias("activities"), F.least(F.lit(1.0), F.coalesce("activities", F.lit(0)) / 10).alias("progress"), status.alias("status"))


def silence(entities: DataFrame, mentions: DataFrame, now: datetime, least: int = 7) -> DataFrame:
    """Entities nobody mentioned for ``least`` days or more: (id, owner, days_silent); the last mention comes from the mentions themselves."""
    last = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.max("created_at").alias("_last"))
    days = F.floor(days_until("_last", now)).cast("int")
    return entities.join(last, "id").select("id", F.col("owner_entity_id").alias("owner"), days.alias("days_silent")).where(F.col("days_silent") >= least)


def gaps(memories: DataFrame, near: float = 0.6, each: int = 50, shown: int = 5) -> DataFrame:
    """Newest questions that no other memory of the owner comes close to; only questions are compared with the rest."""
    live = memories.where("state = 'active'")
    asked = _top(live, each, F.col("created_at").desc()).where(filters.is_question(F.col("content")))
    answered = search.similarity_between(asked.select("id", "entity_id", "embedding"), live.select("id", "entity_id", "embedding"), "entity_id", near).where("a <> b").select(F.col("a").alias("id")).distinct()
    return _top(asked.join(answered, "id", "left_anti"), shown, F.col("created_at").desc())


def confluence(signals: DataFrame, scale: float = 1.0) -> DataFrame:
    """(entity_id, score): per owner the sum over signals of weight x (0.5 + mean stability / scale), each rounded half up. ``signals`` (entity_id, signal, stability)."""
    means = signals.groupBy("entity_id", "signal").agg(F.avg("stability").alias("_mean"))
    weight = F.element_at(F.create_map(*[x for k, t in TIERS.items() for x in (F.lit(k), F.lit(float(WEIGHTS[t])))]), F.col("signal"))
    return means.groupBy("entity_id").agg(F.sum(round_half_up(weight * (0.5 + F.col("_mean") / scale))).alias("score"))


def fingerprint(signals: DataFrame) -> DataFrame:
    """(entity_id, fingerprint): the first 16 hex digits of the hash of all 'signal:id' parts in order."""
    parts = signals.select("entity_id", F.concat_ws(":", "signal", "id").alias("p")).distinct().groupBy("entity_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("entity_id", F.substring(F.sha2(F.concat_ws("|", "p"), 256), 1, 16).alias("fingerprint"))


def relationships(entities: DataFrame, mentions: DataFrame, vectors: DataFrame, plans: DataFrame, now: datetime, least: int = 7, near: float = 0.4, top: int = 10, soon: timedelta = timedelta(days=14)) -> DataFrame:
    """(id, owner, days_silent, plans, urgency) of silent entities that matter: 'urgent' if a close plan ends soon, 'attention' if there is one, else 'info' (after more than 14 days only).

    ``vectors`` (id, owner_entity_id, embedding) of entities; ``plans`` (id, entity_id, embedding, expires_at). Only
    entities are compared with plans, block by block, and each entity keeps its ``top`` plans.
    """
    close = search.similarity_between(vectors.select("id", F.col("owner_entity_id").alias("entity_id"), "embedding"), plans.select("id", "entity_id", "embedding"), "entity_id", near, top=top)
    ends = close.join(plans.select(F.col("id").alias("b"), "expires_at"), "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("plans"), F.bool_or(F.coalesce(F.col("expires_at") < at(now + soon), F.lit(False))).alias("_soon"))
    quiet = silence(entities, mentions, now, least).join(ends, "id", "left")
    urgency = F.when(F.col("plans").isNull(), "info").when(F.col("_soon"), "urgent").otherwise("attention")
    return quiet.where(F.col("plans").isNotNull() | (F.col("days_silent") > 14)).select("id", "owner", "days_silent", F.coalesce("plans", F.lit(0)).alias("plans"), urgency.alias("urgency"))


def _named(signals: dict[str, DataFrame], *columns: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("_signal"), *columns) for name, df in signals.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_agent(signals: dict[str, DataFrame]) -> DataFrame:
    """(agent_id, one count per signal)."""
    return _named(signals, "agent_id").groupBy("agent_id").agg(*[F.count_if(F.col("_signal") == name).alias(name) for name in signals])


def summary(signals: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, total, one count per signal)."""
    return _named(signals, "entity_id").groupBy("entity_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("_signal") == name).alias(name) for name in signals])


def summary_text(signals: dict[str, DataFrame], each: int = 3, width: int = 60) -> DataFrame:
    """(entity_id, text): per owner one line for each of the first ``each`` memories of a signal, 'signal: beginning of the text', lines in order."""
    rows = _named(signals, "entity_id", "id", "content")
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id", "_signal").orderBy("id"))).where(F.col("_n") <= each)
    lines = ranked.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.concat("_signal", F.lit(": "), F.substring("content", 1, width)))).alias("_l"))
    return lines.select("entity_id", F.array_join("_l", "\n").alias("text"))
