"""Lifecycle jobs and commands: each returns the rows to change, or the new version of a table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at
from memlode.operators import scoring

SCHEDULE_TAG = r"^(cron:|hourly|daily|weekly|weekdays|monthly|every:|once:)"


def is_scheduled(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.rlike(SCHEDULE_TAG)), F.lit(False))


def decay_transitions(memories: DataFrame, now: datetime) -> DataFrame:
    """Rows whose state no longer fits their decay: schedules are exempt, resolved rows only move towards deletion."""
    rows = memories.where(F.col("state").isin("active", "stale", "resolved") & ~is_scheduled(F.col("tags")))
    judged = rows.withColumn("factor", F.least(scoring.decay_factor(now) + scoring.burst_boost(now), F.lit(1.0)))
    moved = judged.select("id", F.col("state").alias("old_state"), scoring.decay_state(F.col("factor")).alias("new_state"), "factor")
    backwards = (F.col("old_state") == "resolved") & F.col("new_state").isin("active", "stale")
    return moved.where((F.col("new_state") != F.col("old_state")) & ~backwards)


def archive_due(memories: DataFrame, now: datetime, after: timedelta = timedelta(days=30)) -> DataFrame:
    return memories.where((F.col("state") == "stale") & (F.col("updated_at") < at(now - after)))


def purge_due(memories: DataFrame, now: datetime, after: timedelta = timedelta(days=90)) -> DataFrame:
    return memories.where((F.col("state") == "deleted") & (F.col("deleted_at") < at(now - after)))


def over_cap(memories: DataFrame, now: datetime, cap: int) -> DataFrame:
    """Rows beyond an owner's ``cap`` best by eviction rank."""
    ranked = memories.withColumn("_v", F.round(scoring.eviction_rank(now), 9))
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("_v"), "id"))).where(F.col("_n") > cap).drop("_v", "_n")


def seeded(requests: DataFrame) -> DataFrame:
    """Requests stored as memories without extraction, with every default filled in."""
    kind = F.lit("CONTEXT")
    return requests.where("content is not null").select(
        "id", "entity_id", F.coalesce(F.nullif(F.col("agent_id"), F.lit("")), F.lit("default")).alias("agent_id"), "content", F.sha2("content", 256).alias("content_hash"), kind.alias("memory_type"),
        F.lit(0.5).alias("importance"), F.lit(0.9).alias("confidence"), scoring.default_stability(kind).alias("stability"), F.lit("active").alias("state"), F.col("created_at").alias("last_accessed_at"), "created_at",
    )


def updated(rows: DataFrame, changes: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """The new version of a table: changed columns that aren't null replace the old ones, and the row's version grows by one."""
    new = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    joined = rows.join(new, key, "left")
    out = []
    for c in rows.columns:
        if c == "updated_at":
            out.append(F.when(F.col("_hit"), at(now)).otherwise(F.col(c)).alias(c))
        elif c == "version":
            out.append(F.when(F.col("_hit"), F.col(c) + 1).otherwise(F.col(c)).alias(c))
        elif f"_new_{c}" in new.columns:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def soft_deleted(rows: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    marked = rows.join(ids.select("id", F.lit(True).alias("_gone")), "id", "left")
    return marked.withColumn("state", F.when(F.col("_gone"), "deleted").otherwise(F.col("state"))).withColumn("deleted_at", F.when(F.col("_gone"), at(now)).otherwise(F.col("deleted_at"))).drop("_gone")


def reinforced(rows: DataFrame, hits: DataFrame, now: datetime) -> DataFrame:
    """After a search: counters up, last access now, stability grown where that is more. ``hits`` (id, hits)."""
    grown = rows.join(hits, "id").withColumn("stability", F.greatest(F.col("stability"), scoring.grown_stability(now)))
    return grown.withColumn("access_count", F.col("access_count") + F.col("hits")).withColumn("last_accessed_at", at(now)).drop("hits")


def over_bytes(rows: DataFrame, cap: int, order: list[Column], key: str = "entity_id", overhead: int = 256) -> DataFrame:
    """Rows of a key beyond its first ``cap`` bytes in an order: text and ``overhead`` of each row added up."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(F.octet_length("content") + overhead).over(w)).where(F.col("_used") > cap).drop("_used")
