"""Selecting memories: conjunctive filters, visibility, tags, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.functions.columns import at
from memlode.sources.parquet import clean_key

SORTABLE = ("created_at", "updated_at", "last_accessed_at", "importance", "confidence", "access_count", "stability", "sentiment")
STATES = ("active", "stale", "resolved", "archived", "deleted")
TYPES = ("IDENTITY", "PREFERENCE", "RELATIONSHIP", "EVENT", "ACTIVITY", "PLAN", "CONTEXT", "EPHEMERAL")
# Openings of internal process messages, and of questions.
META_PREFIXES = ("monitoring ", "syncing ", "cleanup ", "standby", "preparing summary", "preparing planning", "wrapping up", "finalizing cleanup", "keeping an eye on", "watching ", "tracking progress on")
QUESTION_WORDS = ("how ", "what ", "why ", "when ", "where ", "who ", "which ", "can ", "does ", "is there ", "should ")


@dataclass(frozen=True)
class Viewer:
    """Who asks: an agent, and its team if it has one."""

    agent_id: str
    team_id: str = ""


def visible_to(viewer: Viewer | None) -> Column:
    """Row-level visibility: everything without a viewer; global rows; the viewer's team's rows; its own private rows. Unknown or null visibility shows to nobody."""
    if viewer is None:
        return F.lit(True)
    kind, own = F.col("visibility"), F.col("agent_id") == viewer.agent_id
    seen = (kind == "global") | ((kind == "private") & own)
    if viewer.team_id:
        seen = seen | ((kind == "team") & (F.col("team_id") == viewer.team_id))
    return F.coalesce(seen, F.lit(False))


def has_all_tags(tags: Sequence[str]) -> Column:
    out = F.lit(True)
    for tag in tags:
        out = out & F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return out


def has_any_tag(tags: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))


def has_tag_prefix(prefix: str) -> Column:
    return F.coalesce(F.exists("tags", lambda t: t.startswith(prefix)), F.lit(False))


def has_tag_text(part: str) -> Column:
    """The looser form: anywhere in the JSON text of the tags."""
    return F.coalesce(F.to_json("tags").contains(part), F.lit(False))


def is_meta(content: Column) -> Column:
    """Process chatter rather than work for the user."""
    text = F.trim(F.lower(content))
    out = F.lit(False)
    for prefix in META_PREFIXES:
        out = out | text.startswith(prefix)
    return out


def is_question(content: Column) -> Column:
    text = F.lower(content)
    out = content.contains("?")
    for start in QUESTION_WORDS:
        out = out | text.startswith(start) | text.contains(" " + start)
    return out


def select_memories(
    memories: DataFrame,
    entity_id: str | None = None,
    agent_id: str | None = None,
    team_id: str | None = None,
    viewer: Viewer | None = None,
    visibilities: Sequence[str] = (),
    types: Sequence[str] = (),
    states: Sequence[str] = (),
    tags: Sequence[str] = (),
    tag_prefix: str | None = None,
    created_before: datetime | None = None,
) -> DataFrame:
    """Rows that meet every given condition. All conditions but tags can be pushed to the Parquet scan."""
    for name, given, allowed in (("state", states, STATES), ("type", types, TYPES)):
        if set(given) - set(allowed):
            raise ValueError(f"unknown {name}: {sorted(set(given) - set(allowed))}")
    out = memories
    for column, value in (("entity_id", entity_id), ("agent_id", agent_id), ("team_id", team_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for column, values in (("visibility", visibilities), ("memory_type", types), ("state", states)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if viewer is not None:
        out = out.where(visible_to(viewer))
    if tags:
        out = out.where(has_all_tags(tags))
    if tag_prefix is not None:
        out = out.where(has_tag_prefix(tag_prefix))
    if created_before is not None:
        out = out.where(F.col("created_at") <= at(created_before))
    return out


def page(memories: DataFrame, order_by: str = "created_at", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in the order of one sortable column, ties by id; a bounded top-k, not a full sort."""
    return memories.orderBy(*ordering(order_by, descending)).offset(offset).limit(limit)


def ordering(order_by: str, descending: bool) -> list[Column]:
    if order_by not in SORTABLE:
        raise ValueError(f"can't sort by {order_by}")
    return [F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_first(), F.col("id").asc()]


def page_after(memories: DataFrame, cursor_id: str, order_by: str = "created_at", descending: bool = True, limit: int = 100) -> DataFrame:
    """The page after a row, by (column, id), so rows that tie with it aren't lost. The cursor is one row: a broadcast. Null sort values come in no page."""
    ordering(order_by, descending)
    cursor = memories.where(F.col("id") == cursor_id).select(F.col(order_by).alias("_at"), F.col("id").alias("_id")).limit(1)
    beyond = (F.col(order_by) < F.col("_at") if descending else F.col(order_by) > F.col("_at")) | ((F.col(order_by) == F.col("_at")) & (F.col("id") > F.col("_id")))
    return page(memories.join(F.broadcast(cursor), beyond).drop("_at", "_id"), order_by, descending, limit)


def recent(memories: DataFrame, now: datetime, hours: float) -> DataFrame:
    return memories.where((F.col("state") == "active") & (F.col("created_at") > at(now - timedelta(hours=hours))))


def confident(memories: DataFrame, least: float) -> DataFrame:
    """Unset confidence (0 or null) passes."""
    return memories.where((F.coalesce("confidence", F.lit(0.0)) == 0) | (F.col("confidence") >= least))


def not_surfaced(memories: DataFrame, surfaced: DataFrame, now: datetime, window: timedelta) -> DataFrame:
    """Without memories surfaced within the window (strict: may leave none)."""
    shown = surfaced.where(F.col("surfaced_at") > at(now - window)).select(clean_key(F.col("memory_id")).alias("id")).distinct()
    return memories.join(shown, "id", "left_anti")


def prefer_not_surfaced(memories: DataFrame, surfaced: DataFrame, now: datetime, window: timedelta, group: str = "entity_id") -> DataFrame:
    """As ``not_surfaced``, but a group of which everything was shown keeps all its rows."""
    shown = surfaced.where(F.col("surfaced_at") > at(now - window)).select(clean_key(F.col("memory_id")).alias("id")).distinct().withColumn("_shown", F.lit(True))
    marked = memories.join(shown, "id", "left")
    fresh = marked.groupBy(group).agg(F.bool_or(F.col("_shown").isNull()).alias("_fresh"))
    return marked.join(fresh, group).where(F.col("_shown").isNull() | ~F.col("_fresh")).drop("_shown", "_fresh")


def valid_id(column: Column) -> Column:
    return F.coalesce(column.rlike(r"^[a-zA-Z0-9_:.\-]+\z") & (F.length(column) <= 256), F.lit(False))


def valid_extraction(memory_type: Column, importance: Column, confidence: Column, content: Column) -> Column:
    """What an extraction must satisfy to be stored."""
    known = F.upper(memory_type).isin(*TYPES)
    return F.coalesce(known & importance.between(0, 1) & confidence.between(0, 1) & F.length(F.trim(content)).between(1, 5000), F.lit(False))


def harmless(text: Column) -> Column:
    """Angle brackets become square ones, so text can't open or close tags of a prompt."""
    return F.translate(text, "<>", "[]")


def with_reasons(extracted: DataFrame) -> DataFrame:
    """Extractions with ``reasons``: what each fails of 'type', 'importance', 'confidence', 'content'; none if it may be stored. Null counts as failing."""
    fails = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    tests = (fails(F.upper("memory_type").isin(*TYPES), "type"), fails(F.col("importance").between(0, 1), "importance"), fails(F.col("confidence").between(0, 1), "confidence"), fails(F.length(F.trim("content")).between(1, 5000), "content"))
    return extracted.withColumn("reasons", F.array_compact(F.array(*tests)))
