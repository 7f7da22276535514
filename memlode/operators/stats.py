"""Aggregates over memories: counts, samples, trends."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at


def by_type_and_state(memories: DataFrame, rollup: bool = False) -> DataFrame:
    """Counts per type and state; with ``rollup`` also per type and in all, from the same partial sums."""
    groups = memories.rollup("memory_type", "state") if rollup else memories.groupBy("memory_type", "state")
    return groups.agg(F.count("*").alias("n"), F.count_if(F.col("deleted_at").isNull()).alias("undeleted"))


def by_owner(memories: DataFrame) -> DataFrame:
    return memories.groupBy("entity_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "stale", "archived", "deleted")])


def storage(memories: DataFrame) -> DataFrame:
    """Bytes of text and vectors per owner."""
    return memories.groupBy("entity_id").agg(F.sum(F.octet_length("content").cast("bigint")).alias("content_bytes"), F.sum(F.coalesce(F.array_size("embedding"), F.lit(0)) * F.lit(4).cast("bigint")).alias("vector_bytes"))


def attribution(memories: DataFrame) -> DataFrame:
    """What each agent's memories contribute to the signals."""
    flagged = F.coalesce(F.exists("confidence_factors", lambda f: f.startswith("conflict_flagged:")), F.lit(False))
    return memories.groupBy("agent_id").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if((F.col("state") == "stale") & (F.col("importance") >= 0.8)).alias("decaying"), F.count_if(flagged).alias("conflicts"))


def first_of_each(rows: DataFrame, group: str, order: Sequence[Column], each: int, total: int) -> DataFrame:
    """The first ``each`` rows of every group, merged and cut to ``total``; the window keeps ``each`` per task before the shuffle."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_n") <= each).drop("_n").orderBy(*order).limit(total)


def sample(rows: DataFrame, now: datetime, each: int, seed: int | None = None) -> DataFrame:
    """Per owner: the ``each`` most important, then the newest of the last day, then (with a seed) random ones, none twice."""
    important = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("importance").desc_nulls_last(), "id")))
    late = at(now - timedelta(hours=24))
    marked = important.withColumn("_late", (F.col("_n") > each) & (F.col("created_at") > late))
    newest = marked.withColumn("_m", F.when(F.col("_late"), F.row_number().over(Window.partitionBy("entity_id", "_late").orderBy(F.desc("created_at"), "id"))))
    slice_ = F.when(F.col("_n") <= each, "important").when(F.col("_m") <= each, "newest")
    out = newest.withColumn("slice", slice_)
    if seed is not None:
        out = out.withColumn("_free", F.col("slice").isNull())
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("entity_id", "_free").orderBy(F.xxhash64("id", F.lit(seed)))))
        out = out.withColumn("slice", F.when(F.col("_free") & (F.col("_k") <= each), "random").otherwise(F.col("slice")))
    return out.where("slice is not null").select(*rows.columns, "slice")


def sentiment_trend(memories: DataFrame, newest: int = 40, least: int = 6) -> DataFrame:
    """Mean sentiment of the later and the earlier half of each owner's newest rows."""
    rows = memories.where((F.col("state") == "active") & (F.col("sentiment") != 0))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "id"))).where(F.col("_n") <= newest)
    counted = ranked.withColumn("_c", F.count("*").over(Window.partitionBy("entity_id")))
    half = F.floor(F.col("_c") / 2)
    halves = counted.groupBy("entity_id").agg(F.max("_c").alias("n"), F.avg(F.when(F.col("_n") <= half, F.col("sentiment"))).alias("recent"), F.avg(F.when(F.col("_n") > half, F.col("sentiment"))).alias("earlier"))
    change = F.col("recent") - F.col("earlier")
    trend = F.when(change > 0.3, "improving").when(change < -0.3, "declining").otherwise("stable")
    return halves.where(F.col("n") >= least).select("entity_id", "n", F.round("recent", 6).alias("recent"), F.round("earlier", 6).alias("earlier"), trend.alias("trend"))
