"""Consolidation: close memories of an owner as groups, with a primary, merged values and provenance; votes on conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.operators.graph import components
from memlode.operators.lifecycle import is_scheduled

# Visibility from the most to the least restrictive.
RESTRICTION = ("private", "team", "global")


def groups(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): connected groups of close pairs (a, b) of one agent, schedules left out.

    A declared variant of a greedy pass in order of importance: the result depends on no order, and no owner's
    rows have to meet in one task.
    """
    free = memories.where(~is_scheduled(F.col("tags"))).select("id", F.coalesce("agent_id", F.lit("")).alias("_agent"))
    left, right = free.toDF("a", "_agent_a"), free.toDF("b", "_agent_b")
    return components(pairs.join(left, "a").join(right, "b").where("_agent_a = _agent_b").select("a", "b"))


def consolidated(memories: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row per group: (primary, members, importance, confidence, visibility, derived_from).

    The most important member (smallest id on ties) is the primary; importance is the mean, a tenth more for each
    further member, at most 1; confidence the greatest; visibility the most restrictive.
    """
    joined = memories.join(grouped, "id")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in RESTRICTION]), F.lower("visibility")), F.lit(1))
    order = F.struct(F.coalesce("importance", F.lit(0.0)).alias("i"), F.col("id"))
    first = F.struct((-F.coalesce("importance", F.lit(0.0))).alias("i"), F.col("id").alias("id"))
    made = joined.groupBy("root").agg(
        F.min(first).alias("_first"), F.count(order).alias("members"), F.avg(F.coalesce("importance", F.lit(0.0))).alias("_mean"), F.max("confidence").alias("confidence"), F.min(rank).alias("_rank"), F.array_sort(F.collect_list("id")).alias("_ids"),
    )
    primary = F.col("_first.id")
    return made.select(
        primary.alias("primary"), "members", F.round(F.least(F.lit(1.0), F.col("_mean") * (1 + 0.1 * (F.col("members") - 1))), 6).alias("importance"), "confidence",
        F.element_at(F.array(*[F.lit(v) for v in RESTRICTION]), F.col("_rank").cast("int")).alias("visibility"), F.array_remove("_ids", primary).alias("derived_from"),
    )


def vote(votes: DataFrame, sure: float = 0.8) -> DataFrame:
    """(id, resolution): the surest vote if it reaches ``sure``, else the strict majority, else 'ask'. ``votes`` (id, resolution, confidence)."""
    counted = votes.groupBy("id", "resolution").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    best = counted.groupBy("id").agg(F.max(F.struct("c", "resolution")).alias("s"), F.max(F.struct("n", "resolution")).alias("m"), F.sum("n").alias("all"))
    said = F.when(F.col("s.c") >= sure, F.col("s.resolution")).when(2 * F.col("m.n") > F.col("all"), F.col("m.resolution")).otherwise("ask")
    return best.select("id", said.alias("resolution"))


def context(members: DataFrame, mentions: DataFrame, graph: DataFrame) -> DataFrame:
    """(root, entities, inner_edges): what the memories of a group (id, root) have in common in the graph: entities mentioned, and relations between two of them."""
    said = mentions.select(F.col("memory_id").alias("id"), F.col("entity_id").alias("e")).join(members, "id").select("root", "e").distinct()
    ends = graph.select(F.col("id").alias("_edge"), "a", "b")
    inner = said.withColumnRenamed("e", "a").join(ends, "a").join(said.withColumnRenamed("e", "b"), ["root", "b"]).groupBy("root").agg(F.countDistinct("_edge").alias("inner_edges"))
    return said.groupBy("root").agg(F.count("*").alias("entities")).join(inner, "root", "left").select("root", "entities", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"))
