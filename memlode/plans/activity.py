"""Logs and schedules: named queries and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from memlode.functions.columns import NOW, micros
from memlode.operators import logs, schedule
from memlode.plans.base import WITH, Catalog, actions, memories, messages
from memlode.sources.parquet import table
from memlode.streaming import windows

C = Catalog()


@C.add(WITH + "select entity_id, hour(created_at) \"hour\", count(*) n from msg where created_at > timestamp '2024-01-18' group by 1, 2")
def hour_histogram(spark, folder):
    return logs.hours_of_day(messages(spark, folder), "created_at", NOW, 14)


@C.add(WITH + ", h as (select entity_id, hour(acted_at) \"hour\", count(*) n from act where acted_at > timestamp '2024-01-01' group by 1, 2) select entity_id, sum(n)::bigint total, case when sum(n) >= 50 and count(*) >= 5 then coalesce(sum(n) filter (\"hour\" = 9), 0) / sum(n) >= 0.02 else true end active from h group by 1")
def rhythm(spark, folder):
    return logs.usually_active(logs.hours_of_day(actions(spark, folder), "acted_at", NOW, 31), 9, least=50)


@C.add(WITH + "select entity_id, count(user_responded) judged, round(case when count(user_responded) > 0 then count(*) filter (user_responded) / count(user_responded)::double else 1 end, 6) rate from act where decision = 'act' group by 1")
def response_rate(spark, folder):
    return logs.response_rate(actions(spark, folder))


@C.add(WITH + ", r as (select entity_id, count(user_responded) judged, case when count(user_responded) > 0 then round(count(*) filter (user_responded) / count(user_responded)::double, 6) else 1 end rate from act where decision = 'act' group by 1) select entity_id, round(case when judged < 3 or rate >= 0.5 then 1 else 2 - 2 * rate end, 6) multiplier from r")
def cooldown_multiplier(spark, folder):
    return logs.response_rate(actions(spark, folder)).select("entity_id", F.round(logs.cooldown_multiplier(F.col("rate"), F.col("judged")), 6).alias("multiplier"))


@C.add(WITH + "select entity_id, count(*) nudges from act where trigger_category = 'nudge' and acted_at > timestamp '2024-01-29' group by 1")
def nudges(spark, folder):
    return logs.acts_since(actions(spark, folder), NOW, timedelta(hours=72)).where("trigger_category = 'nudge'").groupBy("entity_id").agg(F.count("*").alias("nudges"))


@C.add(WITH + "select entity_id, decision, acted_at, id from (select *, row_number() over (partition by entity_id, decision order by acted_at desc, id desc) n from act) where n = 1")
def last_act(spark, folder):
    return logs.last_per_decision(actions(spark, folder))


@C.add(WITH + "select entity_id, decision, count(*) n from act where acted_at > timestamp '2024-01-25' group by 1, 2")
def decisions_window(spark, folder):
    return logs.acts_since(actions(spark, folder), NOW, timedelta(days=7)).groupBy("entity_id", "decision").agg(F.count("*").alias("n"))


@C.add(WITH + "select id, entity_id from (select *, row_number() over (partition by entity_id order by acted_at desc, id) n from act where decision = 'act' and user_responded is null and acted_at < timestamp '2024-01-31') where n <= 20")
def unchecked_acts(spark, folder):
    return logs.unchecked(actions(spark, folder), NOW, timedelta(hours=24)).select("id", "entity_id")


@C.add(WITH + "select a.id, a.entity_id, exists (select 1 from act m where m.decision = 'suppress_cooldown' and m.entity_id = a.entity_id and m.acted_at > a.acted_at and m.acted_at < a.acted_at + interval 2 hour) answered from act a where a.decision = 'act'")
def responded_range_join(spark, folder):
    log = actions(spark, folder)
    clicks = log.where("decision = 'suppress_cooldown'").select("id", "entity_id", F.col("acted_at").alias("created_at"))
    return logs.answered(log, clicks)


@C.add(WITH + ", g as (select *, case when acted_at - lag(acted_at) over w <= interval 12 hour then 0 else 1 end brk from act window w as (partition by entity_id order by acted_at, id)), s as (select entity_id, acted_at, sum(brk) over (partition by entity_id order by acted_at, id rows unbounded preceding) \"session\" from g) select entity_id, \"session\"::bigint \"session\", count(*) n, min(acted_at) started from s group by 1, 2")
def sessions_gap(spark, folder):
    rows = logs.sessions(actions(spark, folder), "acted_at", timedelta(hours=12))
    return rows.groupBy("entity_id", "session").agg(F.count("*").alias("n"), F.min("acted_at").alias("started"))


@C.add(WITH + ", r as (select *, row_number() over (partition by entity_id order by created_at desc, id) n, max(created_at) over (partition by entity_id) newest from msg) select id, entity_id from r where n <= 5 and newest - created_at <= interval 2 hour")
def session_recent(spark, folder):
    return logs.newest_session(messages(spark, folder), "created_at", timedelta(hours=2)).select("id", "entity_id")


@C.add(WITH + "select id, round(sum(value) over (partition by entity_id order by acted_at range between interval 1 hour preceding and current row), 4) spent from act")
def token_window(spark, folder):
    rows = logs.spent(actions(spark, folder), "value", "acted_at", timedelta(hours=1))
    return rows.select("id", F.round("spent", 4).alias("spent"))


@C.add(WITH + "select entity_id, round(sum(value), 4) total, round(coalesce(sum(value) filter (acted_at > timestamp '2024-01-29 23:00:00'), 0), 4) last_hour, round(coalesce(sum(value) filter (acted_at >= timestamp '2024-01-29'), 0), 4) today from act where acted_at < timestamp '2024-01-30' group by 1")
def token_usage(spark, folder):
    rows = actions(spark, folder).where("acted_at < timestamp_ntz'2024-01-30 00:00:00'")
    part = lambda since: F.coalesce(F.sum(F.when(F.expr(since), F.col("value"))), F.lit(0.0))
    return rows.groupBy("entity_id").agg(F.round(F.sum("value"), 4).alias("total"), F.round(part("acted_at > timestamp_ntz'2024-01-29 23:00:00'"), 4).alias("last_hour"), F.round(part("acted_at >= timestamp_ntz'2024-01-29 00:00:00'"), 4).alias("today"))


@C.add(WITH + "select entity_id, fingerprint, count(*) times, count(*) filter (coalesce(user_responded, false)) answered, max(acted_at) last_at, count(*) >= 8 and count(*) filter (coalesce(user_responded, false)) = 0 dropped from act where decision = 'act' group by 1, 2")
def escalation(spark, folder):
    return logs.escalation(actions(spark, folder))


@C.add(WITH + ", r as (select *, sum((decision <> 'suppress_stale')::int) over (partition by entity_id order by acted_at desc, id desc rows unbounded preceding) seen from act), f as (select entity_id, count(*) filter (seen = 0) run from r group by 1) select entity_id, run, pow(2.0, least(run, 5)) backoff, case when run >= 3 then least(run - 2, 6) else 0 end::int cooloff_hours from f")
def failure_backoff(spark, folder):
    return logs.failures(actions(spark, folder), F.col("decision") == "suppress_stale")


@C.add(WITH + "select entity_id, count(*) filter (acted_at > timestamp '2024-01-23') - count(*) filter (acted_at > timestamp '2024-01-16' and acted_at <= timestamp '2024-01-23') velocity from act group by 1")
def velocity(spark, folder):
    late = F.count_if(F.expr("acted_at > timestamp_ntz'2024-01-23 00:00:00'"))
    before = F.count_if(F.expr("acted_at > timestamp_ntz'2024-01-16 00:00:00' and acted_at <= timestamp_ntz'2024-01-23 00:00:00'"))
    return actions(spark, folder).groupBy("entity_id").agg((late - before).alias("velocity"))


@C.add(WITH + "select id, entity_id, n tick from (select *, row_number() over (partition by entity_id order by acted_at desc, id desc) n from act) where n <= 100")
def recent_ticks(spark, folder):
    from pyspark.sql.window import Window

    w = Window.partitionBy("entity_id").orderBy(F.desc("acted_at"), F.desc("id"))
    return actions(spark, folder).withColumn("tick", F.row_number().over(w)).where("tick <= 100").select("id", "entity_id", "tick")


@C.add(WITH + ", a as (select id, entity_id, acted_at, value, lag(value) over (partition by entity_id order by acted_at, id) before from act where decision = 'act') select id, entity_id, round(value - before, 4) delta from a where before is not null and value > before")
def positive_deltas(spark, folder):
    from pyspark.sql.window import Window

    w = Window.partitionBy("entity_id").orderBy("acted_at", "id")
    rows = actions(spark, folder).where("decision = 'act'").withColumn("before", F.lag("value").over(w))
    return rows.where("value > before").select("id", "entity_id", F.round(F.col("value") - F.col("before"), 4).alias("delta"))


@C.add(WITH + """, r as (select *, row_number() over (partition by entity_id order by created_at desc, id) n from mem where state = 'active' and created_at > timestamp '2023-11-03'),
k as (select *, count(*) over (partition by entity_id) c from r where n <= 500),
t as (select entity_id, unnest(list_distinct(list_concat([lower(memory_type)], list_transform(list_filter(tags, lambda x: not starts_with(x, 'cron:')), lambda x: lower(x))))) topic from k where c >= 10 and dayofweek(created_at) = dayofweek(timestamp '2024-02-01'))
select entity_id, topic, count(*) n, round(least(1, count(*) / 10.0), 6)::double confidence from t group by 1, 2 having count(*) >= 3""")
def dow_topics(spark, folder):
    return logs.weekday_topics(memories(spark, folder, "entity_id", "state", "created_at", "memory_type", "tags"), NOW)


# ---- schedules: the test tables' tags have no prefix
_TAG = "(select id, created_at, last_accessed_at, list_filter(tags, lambda t: regexp_matches(t, '^(cron:)?(hourly|daily|weekdays|weekly|monthly|every|once)(:|$)'))[1] tag from mem)"


@C.add(WITH + f"select id, tag, case when starts_with(tag, 'every') then 'interval' when starts_with(tag, 'daily') then 'daily' else 'monthly' end kind, case when starts_with(tag, 'every') then regexp_extract(tag, '([0-9]+)h', 1)::double * 3600 end \"seconds\", case when starts_with(tag, 'daily') then split_part(tag, ':', 2)::int when starts_with(tag, 'monthly') then split_part(tag, ':', 3)::int end \"hour\", case when starts_with(tag, 'monthly') then split_part(tag, ':', 2)::int end \"day\" from {_TAG} where tag is not null")
def cron_parse(spark, folder):
    rows = memories(spark, folder, "tags").withColumn("tag", schedule.schedule_tag(F.col("tags"))).where("tag is not null")
    return schedule.parsed(rows, F.col("tag")).select("id", "tag", F.col("s_kind").alias("kind"), F.col("s_seconds").alias("seconds"), F.col("s_hour").alias("hour"), F.col("s_day").alias("day"))


_NEXT = """case when starts_with(tag, 'every') then base + interval 4 hour
when starts_with(tag, 'daily') then case when date_trunc('day', base) + interval 9 hour > base then date_trunc('day', base) + interval 9 hour else date_trunc('day', base) + interval 33 hour end
else (select min(t) from (select date_trunc('month', base) + to_months(m::int) + interval 30 day + interval 8 hour t, last_day(date_trunc('month', base) + to_months(m::int)) l from range(0, 4) r(m)) where day(l) = 31 and t > base) end"""


@C.add(WITH + f", t as (select id, tag, coalesce(last_accessed_at, created_at) base from {_TAG} where tag is not null) select id, {_NEXT} next_run from t")
def cron_next(spark, folder):
    rows = schedule.planned(memories(spark, folder, "tags", "created_at", "last_accessed_at"), F.coalesce("last_accessed_at", "created_at"))
    return rows.select("id", F.col("next_at").alias("next_run"))


@C.add(WITH + f", t as (select id, tag, coalesce(last_accessed_at, created_at) base from {_TAG} where tag is not null), n as (select *, {_NEXT} next_run from t) select id, coalesce(next_run <= timestamp '2024-02-01', false) due, coalesce(timestamp '2024-02-01' - next_run > case when starts_with(tag, 'every') then interval 8 hour else interval 24 hour end, false) missed from n")
def cron_due(spark, folder):
    rows = schedule.planned(memories(spark, folder, "tags", "created_at", "last_accessed_at"), F.coalesce("last_accessed_at", "created_at"))
    return rows.select("id", schedule.due(F.col("next_at"), NOW).alias("due"), schedule.missed(F.col("next_at"), NOW).alias("missed"))


@C.add(WITH + f", t as (select id, tag, coalesce(last_accessed_at, created_at) base from {_TAG} where tag is not null), n as (select t.*, m.state, {_NEXT} next_run from t join mem m using (id)) select state, case when state not in ('active', 'stale') then 'inactive' when next_run is null then 'ended' when timestamp '2024-02-01' - next_run > case when starts_with(tag, 'every') then interval 8 hour else interval 24 hour end then 'missed' when next_run <= timestamp '2024-02-01' then 'due' else 'waiting' end diagnosis, count(*) n from n group by 1, 2")
def cron_diagnose(spark, folder):
    rows = schedule.planned(memories(spark, folder, "tags", "state", "created_at", "last_accessed_at"), F.coalesce("last_accessed_at", "created_at"))
    said = F.when(~F.col("state").isin("active", "stale"), "inactive").when(F.col("next_at").isNull(), "ended").when(schedule.missed(F.col("next_at"), NOW), "missed").when(schedule.due(F.col("next_at"), NOW), "due").otherwise("waiting")
    return rows.select("state", said.alias("diagnosis")).groupBy("state", "diagnosis").agg(F.count("*").alias("n"))


# ---- windows over the event stream; streaming.windows has the streaming twins, tested to agree


@C.add("select event_type, time_bucket(interval 1 hour, ts) window_start, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def window_tumbling(spark, folder):
    return windows.tumbling(table(spark, folder, "events"), "1 hour")


@C.add("select event_type, s window_start, count(*) n, round(sum(value), 4) total from (select *, unnest([time_bucket(interval 30 minute, ts), time_bucket(interval 30 minute, ts) - interval 30 minute]) s from events) group by 1, 2")
def window_sliding(spark, folder):
    return windows.sliding(table(spark, folder, "events"), "1 hour", "30 minutes")


@C.add("with g as (select user_id, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end b from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) started, max(ts) last_event, count(*) n from s group by user_id, k")
def window_sessions(spark, folder):
    return windows.session(table(spark, folder, "events"), "2 hours")


@C.add(WITH + ", f as (select entity_id, count(*) filter (decision = 'act' and acted_at > timestamp '2024-01-29 20:00:00') acts, count(*) n from act where acted_at > timestamp '2024-01-29' group by 1) select entity_id, least(1800, greatest(60, 300 * case when acts > 0 then 0.5 else 1 end * case when n > 5 then 0.5 when n = 0 then 1.5 else 1 end * 1.0))::double \"seconds\" from f")
def adaptive_interval(spark, folder):
    log = actions(spark, folder).where("acted_at > timestamp_ntz'2024-01-29 00:00:00'")
    seen = log.groupBy("entity_id").agg(F.count_if(F.expr("decision = 'act' and acted_at > timestamp_ntz'2024-01-29 20:00:00'")).alias("acts"), F.count("*").alias("n"))
    return seen.select("entity_id", windows.adaptive_seconds(F.col("acts") > 0, F.lit(1.0), F.col("n"), F.lit(False), F.lit(0)).alias("seconds"))


@C.add("select user_id, event_type, count(*) n, max(ts) last_at from events group by 1, 2")
def event_counts(spark, folder):
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@C.add("select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) pause from events")
def pauses(spark, folder):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", "event_id", (micros("ts") - micros(F.lag("ts").over(w))).alias("pause"))
