"""Schedules kept in tags: grammar, next run, due, diagnosis. Times are wall-clock times of a zone, UTC unless named.

Grammar, with or without the prefix ``cron:``: hourly; daily[:HH:MM[:ZONE]]; weekly[:DAY[:HH:MM]]; weekdays:HH:MM;
monthly[:D:HH:MM]; every:DURATION (as 1h30m); once:TIME (ISO 8601).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.functions.columns import at, micros

# Names of weekdays, Sunday is 0; seconds of the units of a duration.
WEEKDAYS = {"sun": 0, "sunday": 0, "mon": 1, "monday": 1, "tue": 2, "tuesday": 2, "wed": 3, "wednesday": 3, "thu": 4, "thursday": 4, "fri": 5, "friday": 5, "sat": 6, "saturday": 6}
UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
_KINDS = r"^(?:cron:)?(hourly|daily|weekdays|weekly|monthly|every|once)(?::(.*))?\z"


def schedule_tag(tags: Column) -> Column:
    """The first tag that is a schedule, null if there is none."""
    return F.get(F.filter(tags, lambda t: t.rlike(_KINDS)), 0)


def _duration(text: Column) -> Column:
    """Seconds of '1h30m'; null unless the whole text is a positive duration."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+)(ms|us|ns|h|m|s)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]+)(ms|us|ns|h|m|s)"), F.lit(2))
    scale = lambda u: F.element_at(F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))]), u)
    total = F.aggregate(F.zip_with(parts, units, lambda p, u: p.cast("double") * scale(u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(text.rlike(r"^(?:[0-9]*\.?[0-9]+(?:ms|us|ns|h|m|s))+\z"), total)


def _stage(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as generated ones: neither filters nor later projections can copy their expressions, so each is planned and run once."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parsed(rows: DataFrame, tag: Column) -> DataFrame:
    """Rows whose tag is a valid schedule, with columns s_kind, s_seconds, s_weekday, s_day, s_hour, s_minute, s_zone and s_once.

    s_kind: interval, daily, weekly, weekdays, monthly or once. ``daily``, ``weekly[:DAY]``, ``monthly`` and
    ``hourly`` without a time are intervals.
    """
    own = rows.columns
    number = lambda c, low, high: F.when(c.rlike(r"^\d{1,2}\z") & c.cast("int").between(low, high), c.cast("int"))
    part = lambda i: F.get("_parts", i)
    out = _stage(rows, _kind=F.regexp_extract(tag, _KINDS, 1), _rest=F.regexp_extract(tag, _KINDS, 2)).where("_kind <> ''")
    out = _stage(out, _parts=F.when(F.col("_rest") == "", F.array().cast("array<string>")).otherwise(F.split("_rest", ":")), _first=F.when(F.col("_kind").isin("daily", "weekdays"), 0).otherwise(1))
    kind, count = F.col("_kind"), F.size("_parts")
    moment = F.coalesce(*[F.try_to_timestamp("_rest", F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")])
    plain = F.when(kind == "hourly", 3600.0).when((kind == "daily") & (count == 0), 86400.0).when((kind == "weekly") & (count <= 1), 604800.0).when((kind == "monthly") & (count == 0), 2592000.0).when(kind == "every", _duration(F.col("_rest")))
    days = F.element_at(F.create_map(*[x for k, v in WEEKDAYS.items() for x in (F.lit(k), F.lit(v))]), F.lower(part(0)))
    out = _stage(out, _seconds=plain, _weekday=days, _day=number(part(0), 1, 31), _hour=number(part(F.col("_first")), 0, 23), _minute=number(part(F.col("_first") + 1), 0, 59), _once=F.when(kind == "once", moment))
    timed = F.col("_hour").isNotNull() & F.col("_minute").isNotNull()
    valid = (
        F.when(F.col("_seconds") > 0, "interval")
        .when((kind == "daily") & timed, "daily")
        .when((kind == "weekly") & timed & F.col("_weekday").isNotNull(), "weekly")
        .when((kind == "weekdays") & timed, "weekdays")
        .when((kind == "monthly") & timed & F.col("_day").isNotNull(), "monthly")
        .when(F.col("_once").isNotNull(), "once")
    )
    out = _stage(out, _valid=valid).where("_valid is not null")
    at_time = F.col("_valid").isin("daily", "weekly", "weekdays", "monthly")
    made = {
        "s_kind": F.col("_valid"), "s_seconds": F.when(F.col("_valid") == "interval", F.col("_seconds")), "s_weekday": F.when(F.col("_valid") == "weekly", F.col("_weekday")),
        "s_day": F.when(F.col("_valid") == "monthly", F.col("_day")), "s_hour": F.when(at_time, F.col("_hour")), "s_minute": F.when(at_time, F.col("_minute")),
        "s_zone": F.when((F.col("_valid") == "daily") & (count >= 3), F.concat_ws("/", F.slice("_parts", 3, 9))), "s_once": F.when(F.col("_valid") == "once", F.col("_once")),
    }
    return _stage(out, **made).select(*own, *made)


def planned(rows: DataFrame, last_run: Column, zone: str = "UTC") -> DataFrame:
    """Rows with a valid schedule among their tags, with its parts (``parsed``) and ``next_at``: the first run after ``last_run``, in UTC.

    A one-off schedule in the past has no next run. Months without the day are skipped; local times that a zone
    skips move on with its clock.
    """
    own = rows.columns
    out = parsed(rows.where(F.exists("tags", lambda t: t.rlike(_KINDS))), schedule_tag(F.col("tags")))
    out = _stage(out, _after=last_run, _zone=F.coalesce("s_zone", F.lit(zone)))
    out = _stage(out, _local=F.convert_timezone(F.lit("UTC"), F.col("_zone"), F.col("_after")), _clock=F.col("s_hour") * 3600 + F.col("s_minute") * 60)
    utc = lambda t: F.convert_timezone(F.col("_zone"), F.lit("UTC"), t)
    kind, weekday = F.col("s_kind"), F.col("s_weekday")
    daily = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda d: F.timestamp_add("SECOND", F.col("_clock"), F.timestamp_add("DAY", d, F.date_trunc("day", "_local").cast("timestamp_ntz"))))
    firsts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda m: F.add_months(F.trunc(F.col("_local").cast("date"), "month"), m))
    monthly = F.transform(F.filter(firsts, lambda d: F.day(F.last_day(d)) >= F.col("s_day")), lambda d: F.timestamp_add("SECOND", F.col("_clock"), F.timestamp_add("DAY", F.col("s_day") - 1, d.cast("timestamp_ntz"))))
    out = _stage(out, _runs=F.when(kind == "monthly", monthly).when(kind.isin("daily", "weekly", "weekdays"), daily))
    fits = lambda t: F.when(kind == "weekly", F.dayofweek(t) - 1 == weekday).when(kind == "weekdays", F.dayofweek(t).between(2, 6)).otherwise(True)
    first = F.get(F.filter("_runs", lambda t: (utc(t) > F.col("_after")) & fits(t)), 0)
    plain = F.when(kind == "interval", F.timestamp_add("MICROSECOND", (F.col("s_seconds") * 1e6).cast("bigint"), F.col("_after"))).when(kind == "once", F.when(F.col("s_once") > F.col("_after"), F.col("s_once"))).otherwise(utc(first))
    return _stage(out, next_at=plain).select(*own, "s_kind", "s_seconds", "next_at")


def due(next_at: Column, now: datetime) -> Column:
    """Whether a run is due."""
    return F.coalesce(next_at <= at(now), F.lit(False))


def missed(next_at: Column, now: datetime) -> Column:
    """Due for longer than the grace (of rows as from ``planned``): twice an interval, else 24 hours."""
    grace = F.when(F.col("s_kind") == "interval", 2 * F.col("s_seconds")).otherwise(F.lit(timedelta(days=1).total_seconds()))
    return F.coalesce((micros(at(now)) - micros(next_at)) / 1e6 > grace, F.lit(False))


def interval_seconds() -> Column:
    """The plain interval reading of a parsed schedule: days, weeks and months as fixed lengths."""
    kind = F.col("s_kind")
    return F.when(kind == "interval", F.col("s_seconds")).when(kind.isin("daily", "weekdays"), 86400.0).when(kind == "weekly", 604800.0).when(kind == "monthly", 2592000.0)
