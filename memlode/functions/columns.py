"""Small column helpers: time arithmetic, clamps, words, cosine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fixed clock of the test tables; every operator takes its clock as a parameter.
NOW = datetime(2024, 2, 1)


def at(moment: datetime) -> Column:
    """A literal timestamp without zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch; timestamps without zone count as UTC."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def days_until(column: Column | str, now: datetime) -> Column:
    """Days from ``column`` to ``now``, at least 0; null stays null."""
    moment = micros(column)
    return F.when(moment.isNotNull(), F.greatest((micros(at(now)) - moment) / F.lit(86_400_000_000.0), F.lit(0.0)))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def clamp(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def words(text: Column) -> Column:
    """Words split at white space, as typed."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for null, empty, unequal lengths, a zero norm or numbers that aren't finite."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0) & (norms < float("inf"))
    return F.when(fits, dot(a, b) / norms).otherwise(F.lit(0.0))


def round_half_up(column: Column) -> Column:
    return F.floor(column + 0.5).cast("bigint")


def distance(a: Column, b: Column) -> Column:
    """1 minus the cosine."""
    return 1 - cosine(a, b)


def normalised(a: Column) -> Column:
    """The vector with length 1; null for a zero vector or numbers that aren't finite."""
    # the length is bound by a lambda: written inside the inner one it would be computed once per element
    scaled = F.transform(F.array(F.sqrt(dot(a, a))), lambda s: F.when((s > 0) & (s < float("inf")), F.transform(a, lambda x: x.cast("double") / s)))
    return F.element_at(scaled, 1)
