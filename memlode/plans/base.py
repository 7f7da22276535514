"""Inputs shared by the named queries: newest rows, and logs derived from the test tables; the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.functions.columns import NOW
from memlode.sources.parquet import clean_key, newest, newest_of_wide, table

__all__ = ["NOW", "Catalog", "actions", "entities", "memories", "messages", "mentions", "relationships", "surfaced", "timedelta"]


class Catalog:
    """Queries and their SQL, registered side by side."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(query):
            self.queries[name or query.__name__] = query
            if sql is not None:
                self.sql[name or query.__name__] = sql
            return query

        return keep


WIDE = ("content", "embedding")


def memories(spark: SparkSession, folder: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Newest row of each memory, with the columns asked for only.

    ``where``: a condition on columns that all versions of a memory share (entity_id, created_at, content, embedding);
    it is applied below the choice of versions and reaches the Parquet scan.
    """
    rows = table(spark, folder, "memories")
    if where is not None:
        rows = rows.where(where)
    pick = newest_of_wide if set(columns) & set(WIDE) else newest
    return pick(rows, "id", list(columns), ["updated_at", "version"])


def entities(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return newest(table(spark, folder, "entities"), "id", list(columns), ["updated_at"])


def relationships(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return newest(table(spark, folder, "relationships"), "id", list(columns), ["updated_at"])


def mentions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Resent mentions are equal copies."""
    rows = table(spark, folder, "entity_mentions").select("id", *columns).dropDuplicates(["id"])
    return _cleaned(rows, "memory_id")


def _cleaned(rows: DataFrame, *references: str) -> DataFrame:
    """References as they are compared everywhere: without blanks around them and without case."""
    return rows.withColumns({r: clean_key(F.col(r)) for r in references if r in rows.columns})


def surfaced(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(table(spark, folder, "surfaced_memories").dropDuplicates(["id"]), "memory_id")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The requests that users sent, as session messages."""
    rows = table(spark, folder, "remember_requests").select(F.col("request_id").alias("id"), "entity_id", "agent_id", "session_id", "content", F.col("received_at").alias("created_at"))
    return rows.dropDuplicates(["id"])


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream read as a log of heartbeat decisions."""
    kind = F.col("event_type")
    decision = F.when(kind.isin("purchase", "signup"), "act").when(kind == "click", "suppress_cooldown").when(kind == "view", "suppress_stale").otherwise("suppress_topic_repeat")
    answered = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_id") % 3 == 1)
    print_ = F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), kind, (F.col("event_id") % 5).cast("string")), 256), 1, 16)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), F.col("ts").alias("acted_at"), decision.alias("decision"),
        F.when(kind == "signup", "nudge").otherwise("signal").alias("trigger_category"), answered.alias("user_responded"), print_.alias("fingerprint"), F.col("value").cast("double").alias("value"),
    )


_KEY = r"nullif(lower(regexp_replace({}, '^[\s\x{{200B}}\x{{FEFF}}]+|[\s\x{{200B}}\x{{FEFF}}]+$', '', 'g')), '')"
_LATEST = "qualify row_number() over (partition by id order by updated_at desc{}) = 1"
WITH = f"""with mem as (select * from memories where id is not null {_LATEST.format(', version desc')}),
ent as (select * from entities where id is not null {_LATEST.format('')}),
rel as (select * from relationships where id is not null {_LATEST.format('')}),
men as (select distinct on (id) * replace ({_KEY.format('memory_id')} as memory_id) from entity_mentions),
sur as (select distinct on (id) * replace ({_KEY.format('memory_id')} as memory_id) from surfaced_memories),
msg as (select distinct on (request_id) request_id id, entity_id, agent_id, session_id, content, received_at created_at from remember_requests),
act as (select event_id id, 'u' || user_id entity_id, ts acted_at,
  case when event_type in ('purchase', 'signup') then 'act' when event_type = 'click' then 'suppress_cooldown' when event_type = 'view' then 'suppress_stale' else 'suppress_topic_repeat' end decision,
  case when event_type = 'signup' then 'nudge' else 'signal' end trigger_category,
  case when event_id % 3 = 0 then null else event_id % 3 = 1 end user_responded,
  substr(sha256(user_id || '|' || event_type || '|' || (event_id % 5)), 1, 16) fingerprint, value::double "value" from events),
clock as (select timestamp '2024-02-01' now_at)
"""


def sql_days(column: str) -> str:
    """Days from a column to the clock, at least 0, in brackets."""
    return f"(case when {column} is not null then greatest((epoch_us(timestamp '2024-02-01') - epoch_us({column})) / 86400000000.0, 0) end)"
