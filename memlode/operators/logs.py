"""Logs of actions and messages: last acts, windows, sessions, budgets, rates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at, micros


def last_per_decision(actions: DataFrame) -> DataFrame:
    """The latest action of each entity and decision; aggregated, not sorted."""
    return actions.groupBy("entity_id", "decision").agg(F.max(F.struct("acted_at", "id")).alias("m")).select("entity_id", "decision", F.col("m.acted_at").alias("acted_at"), F.col("m.id").alias("id"))


def acts_since(actions: DataFrame, now: datetime, window: timedelta) -> DataFrame:
    return actions.where(F.col("acted_at") > at(now - window))


def unchecked(actions: DataFrame, now: datetime, age: timedelta, limit: int = 20) -> DataFrame:
    """Acts nobody has judged yet, older than ``age``, newest first per entity."""
    rows = actions.where((F.col("decision") == "act") & F.col("user_responded").isNull() & (F.col("acted_at") < at(now - age)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("acted_at"), "id"))).where(F.col("_n") <= limit).drop("_n")


def response_rate(actions: DataFrame) -> DataFrame:
    """Answered share of judged acts; 1 where none was judged."""
    acts = actions.where("decision = 'act'").groupBy("entity_id").agg(F.count("user_responded").alias("judged"), F.count_if("user_responded").alias("answered"))
    return acts.select("entity_id", "judged", F.round(F.when(F.col("judged") > 0, F.col("answered") / F.col("judged")).otherwise(1.0), 6).alias("rate"))


def cooldown_multiplier(rate: Column, judged: Column, least: int = 3) -> Column:
    """2 for a rate of 0, falling to 1 at one half; 1 with too few judgements."""
    return F.when((judged < least) | (rate >= 0.5), 1.0).otherwise(2.0 - 2.0 * rate)


def answered(actions: DataFrame, messages: DataFrame, within: timedelta = timedelta(hours=2)) -> DataFrame:
    """Acts with whether a message of the same entity followed within a time: an interval join by equal time slots.

    Every act asks for the two or more slots its interval touches, so the join is an equi-join on (entity, slot)
    and never pairs all acts with all messages of an entity.
    """
    size = int(within.total_seconds() * 1e6)
    acts = actions.where("decision = 'act'").withColumn("_from", micros("acted_at"))
    asked = acts.select("id", "entity_id", "_from", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_from") + size) / size))).alias("_slot"))
    sent = messages.select(F.col("entity_id"), micros("created_at").alias("_at"), F.floor(micros("created_at") / size).alias("_slot")).distinct()
    hits = asked.join(sent, ["entity_id", "_slot"]).where((F.col("_at") > F.col("_from")) & (F.col("_at") < F.col("_from") + size)).select("id").distinct().withColumn("_hit", F.lit(True))
    return acts.join(hits, "id", "left").select("id", "entity_id", F.coalesce("_hit", F.lit(False)).alias("answered"))


def sessions(rows: DataFrame, time: str, gap: timedelta, key: str = "entity_id") -> DataFrame:
    """Numbers the sessions of each key: a new one after a pause longer than ``gap``."""
    w = Window.partitionBy(key).orderBy(time, "id")
    paused = F.coalesce((micros(time) - micros(F.lag(time).over(w))) > int(gap.total_seconds() * 1e6), F.lit(True))
    return rows.withColumn("session", F.sum(paused.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def newest_session(rows: DataFrame, time: str, gap: timedelta, last: int = 5, key: str = "entity_id") -> DataFrame:
    """Of each key's ``last`` rows, those within ``gap`` of the newest."""
    w = Window.partitionBy(key).orderBy(F.desc(time), "id")
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    newest = F.max(time).over(Window.partitionBy(key))
    return ranked.withColumn("_newest", newest).where(micros("_newest") - micros(time) <= int(gap.total_seconds() * 1e6)).drop("_n", "_newest")


def spent(rows: DataFrame, amount: str, time: str, window: timedelta, key: str = "entity_id") -> DataFrame:
    """Running sum per key over the window that ends with each row."""
    order = micros(time)
    return rows.withColumn("spent", F.sum(amount).over(Window.partitionBy(key).orderBy(order).rangeBetween(-int(window.total_seconds() * 1e6), 0)))


def escalation(actions: DataFrame, drop_at: int = 8) -> DataFrame:
    """How often each topic (fingerprint) of an entity came up unanswered, and whether to drop it."""
    topics = actions.where("decision = 'act'").groupBy("entity_id", "fingerprint").agg(F.count("*").alias("times"), F.count_if(F.coalesce("user_responded", F.lit(False))).alias("answered"), F.max("acted_at").alias("last_at"))
    return topics.withColumn("dropped", (F.col("times") >= drop_at) & (F.col("answered") == 0))


def failures(actions: DataFrame, failed: Column) -> DataFrame:
    """Length of the current run of failures per entity, with the back-off 2^min(n, 5) and a cool-off of 1 to 6 hours after three."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("acted_at"), F.desc("id"))
    marked = actions.withColumn("_ok", (~failed).cast("int")).withColumn("_seen", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = marked.groupBy("entity_id").agg(F.count_if(F.col("_seen") == 0).alias("run"))
    return run.select("entity_id", "run", F.pow(F.lit(2.0), F.least("run", F.lit(5))).alias("backoff"), F.when(F.col("run") >= 3, F.least(F.col("run") - 2, F.lit(6))).otherwise(0).cast("int").alias("cooloff_hours"))


def hours_of_day(rows: DataFrame, time: str, now: datetime, days: int) -> DataFrame:
    """Messages per entity and hour (UTC) of the last days."""
    return rows.where(F.col(time) > at(now - timedelta(days=days))).groupBy("entity_id", F.hour(time).alias("hour")).agg(F.count("*").alias("n"))


def usually_active(hours: DataFrame, hour: int, least: int = 100, spread: int = 5, share: float = 0.02) -> DataFrame:
    """Whether an hour holds at least ``share`` of an entity's messages; true where there is too little to tell."""
    totals = hours.groupBy("entity_id").agg(F.sum("n").alias("total"), F.count("*").alias("hours"), F.sum(F.when(F.col("hour") == hour, F.col("n")).otherwise(0)).alias("here"))
    enough = (F.col("total") >= least) & (F.col("hours") >= spread)
    return totals.select("entity_id", "total", F.when(enough, F.col("here") / F.col("total") >= share).otherwise(True).alias("active"))


def weekday_topics(memories: DataFrame, now: datetime, days: int = 90, newest: int = 500, least_rows: int = 10, least: int = 3) -> DataFrame:
    """Topics that come up on the clock's weekday: (entity_id, topic, n, confidence); from each owner's newest rows."""
    rows = memories.where((F.col("state") == "active") & (F.col("created_at") > at(now - timedelta(days=days))))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id"))).where(F.col("_n") <= newest)
    counted = ranked.withColumn("_c", F.count("*").over(Window.partitionBy("entity_id"))).where(F.col("_c") >= least_rows)
    topics = F.array_distinct(F.concat(F.array(F.lower("memory_type")), F.transform(F.filter("tags", lambda t: ~t.startswith("cron:")), lambda t: F.lower(t))))
    exploded = counted.where(F.dayofweek("created_at") == F.dayofweek(at(now))).select("entity_id", F.explode(topics).alias("topic"))
    return exploded.groupBy("entity_id", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity_id", "topic", "n", F.round(F.least(F.lit(1.0), F.col("n") / 10), 6).alias("confidence"))


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """(entity_id, id, delta): what got better from one snapshot of an entity to the next.

    ``snapshots`` (entity_id, id, acted_at, goals map of plan -> status, silences map of entity -> days, mood). A goal
    that rose, an entity silent for more than 7 days that now is for less than half of that, a declining mood that
    no longer declines. What only one of the two snapshots knows is no change.
    """
    w = Window.partitionBy("entity_id").orderBy("acted_at", "id")
    rows = snapshots.withColumns({f"_{c}": F.lag(c).over(w) for c in ("goals", "silences", "mood")})
    rank = lambda s: F.array_position(F.array(*[F.lit(x) for x in ("no_activity", "stalled", "at_risk", "on_track")]), s)
    both = lambda now, before: F.map_zip_with(now, before, lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    rose = F.exists(F.map_values(both(F.col("goals"), F.col("_goals"))), lambda x: F.coalesce(rank(x["a"]) > rank(x["b"]), F.lit(False)))
    back = F.exists(F.map_values(both(F.col("silences"), F.col("_silences"))), lambda x: F.coalesce((x["b"] > 7) & (x["a"] < F.floor(x["b"] / 2)), F.lit(False)))
    mood = (F.col("_mood") == "declining") & F.col("mood").isin("stable", "improving")
    said = F.array_compact(F.array(F.when(rose, "goal_improved"), F.when(back, "entity_reengaged"), F.when(mood, "sentiment_improved")))
    return rows.select("entity_id", "id", F.explode(said).alias("delta"))


def repeated_topics(current: DataFrame, log: DataFrame, window: timedelta, overlap: float = 0.85) -> DataFrame:
    """(entity_id, verdict) of each entity's current row: 'overlap' if an act within the window had the same fingerprint and more than ``overlap`` of the current topics, 'suppressed' if a decision not to act within twice the window had it, else 'fresh'.

    Both frames: entity_id, acted_at, decision, fingerprint, topics. The fingerprint is part of the join key, so an
    entity's log is never joined whole.
    """
    now = current.select("entity_id", F.col("acted_at").alias("_now"), "fingerprint", F.col("topics").alias("_topics"))
    met = now.join(log.select("entity_id", "fingerprint", "acted_at", "decision", "topics"), ["entity_id", "fingerprint"])
    age, span = micros("_now") - micros("acted_at"), int(window.total_seconds() * 1e6)
    share = F.size(F.array_intersect("_topics", "topics")) / F.greatest(F.size("_topics"), F.lit(1))
    judged = met.groupBy("entity_id").agg(
        F.bool_or((F.col("decision") == "act") & (age <= span) & (share > overlap)).alias("_same"), F.bool_or((F.col("decision") != "act") & (age <= 2 * span)).alias("_shut"),
    )
    verdict = F.when(F.col("_same"), "overlap").when(F.col("_shut"), "suppressed").otherwise("fresh")
    return current.select("entity_id").join(judged, "entity_id", "left").select("entity_id", verdict.alias("verdict"))
