"""Windows and state over event streams; each function takes a batch or a streaming DataFrame of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

LATENESS = "10 minutes"


def events_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream of events, times as instants."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _timed(events: DataFrame) -> DataFrame:
    moments = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return moments.withWatermark("ts", LATENESS) if events.isStreaming else moments


def _counts(events: DataFrame, window: Column) -> DataFrame:
    grouped = _timed(events).groupBy("event_type", window.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    """Events and their value per type and window; late rows beyond the watermark are dropped on a stream."""
    return _counts(events, F.window("ts", size))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return _counts(events, F.window("ts", size, step))


def session(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user that end after a pause of ``gap``."""
    grouped = _timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return grouped.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n")


def adaptive_seconds(acted: Column, period: Column, signals: Column, busy: Column, failures: Column, base: float = 300.0, low: float = 60.0, high: float = 1800.0) -> Column:
    """Seconds to the next check: sooner after an act, with many signals or busy memory; later with none or after failures."""
    load = F.when(signals > 5, 0.5).when(signals == 0, 1.5).otherwise(1.0)
    wait = base * F.when(acted, 0.5).otherwise(1.0) * period * load * F.when(busy, 0.5).otherwise(1.0) * F.pow(F.lit(2.0), F.least(failures, F.lit(5)))
    return F.least(F.greatest(wait, F.lit(low)), F.lit(high))


def fan_out(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, any_type: Callable[[DataFrame, int], None] | None = None):
    """Starts a query that hands each micro-batch to the handlers of its event types, and to ``any_type``.

    A batch is kept while its handlers run; a batch that fails is run again with the same number, so handlers
    that key their writes by it take effect once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.where(F.col("event_type") == kind), number)
            if any_type:
                any_type(batch, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def budget(events: DataFrame, limit: float, window_seconds: int = 60, late_seconds: int = 600) -> DataFrame:
    """Per user: what was spent within the window that ends with each event, and whether the event fits.

    The state holds an event as long as one that the watermark still lets in (``late_seconds``) could need it, and a
    user without events for that time has no state. Each batch is worked through in order of time; events of a
    later batch that belong before known ones count those of their own window only.
    On a batch the same result comes from a range window; ``tests`` hold both against each other.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, amounts = (np.array(x, dtype=float) for x in (state.get if state.exists else ([], [])))
        for frame in frames:
            rows = frame.sort_values(["ts", "event_id"])
            now, spent = rows["ts"].astype("int64").to_numpy() / _per_second(rows["ts"]), rows["value"].to_numpy(float)
            joined, value = np.concatenate([times, now]), np.concatenate([amounts, spent])
            order = np.argsort(joined, kind="stable")
            joined, value = joined[order], value[order]
            sums = np.concatenate([[0.0], np.cumsum(value)])
            place = np.argsort(order, kind="stable")[len(times) :]
            total = np.round(sums[place + 1] - sums[np.searchsorted(joined, now - window_seconds, side="left")], 4)
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "spent": total, "fits": total <= limit})
            times, amounts = joined, value
        seen = state.getCurrentWatermarkMs() / 1000
        needed = times >= max(seen, 0) - window_seconds if len(times) else np.zeros(0, bool)
        times, amounts = times[needed], amounts[needed]
        state.update((times.tolist(), amounts.tolist()))
        if len(times):
            state.setTimeoutTimestamp(int(max(times[-1] + window_seconds + late_seconds, seen + 1) * 1000))

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_seconds} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, spent double, fits boolean", "t array<double>, v array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _per_second(times: pd.Series) -> float:
    """Units of a column's integers in a second."""
    unit = getattr(times.dtype, "unit", "ns")
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[unit]


def watch(events: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]], emit: Callable[[DataFrame, int], None], checkpoint: str, key: str = "entity_id"):
    """Starts a query that runs checks over the owners each micro-batch touches, and emits what they find.

    ``checks``: name -> function from a frame of owners (``key``) to rows with ``key`` and ``id``. ``emit`` gets one
    frame per batch: (key, check, id) for every finding and a row with a null id and the number of findings per
    owner; owners without findings get a row with 0. A batch that fails is run again with the same number.
    """

    def each(batch: DataFrame, number: int) -> None:
        owners = batch.select(key).where(F.col(key).isNotNull()).distinct().persist()
        try:
            found = [check(owners).select(key, F.lit(name).alias("check"), F.col("id").cast("string").alias("id")) for name, check in checks.items()]
            rows = found[0]
            for part in found[1:]:
                rows = rows.unionByName(part)
            counts = owners.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.lit("all").alias("check"), F.lit(None).cast("string").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))
            emit(rows.withColumn("n", F.lit(1).cast("bigint")).unionByName(counts), number)
        finally:
            owners.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
