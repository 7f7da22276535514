"""Queries of the training-data problems, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.llm import copies, leak, mix, names, near, pii, subjects, vectors
from memlode.llm.sql import SQL  # noqa: F401
from memlode.sources.parquet import newest, table

_NEWEST = ["updated_at", "version"]


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    return names.linked(table(spark, folder, "entities"), table(spark, folder, "entity_mentions"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_pairs(_linked(spark, folder))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of entities by the smallest id, with their size."""
    return _linked(spark, folder).groupBy(F.col("root").alias("entity_id")).agg(F.count("*").alias("spellings"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = vectors.similar_pairs(table(spark, folder, "memories"), "id", "embedding", _NEWEST, least=0.93)
    return pairs.select(F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b"))


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every memory whose number is divisible by 50, among all memories."""
    rows = table(spark, folder, "memories")
    asked = rows.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 50 == 0).select("id").distinct()
    return vectors.nearest(rows, "id", "embedding", _NEWEST, spread=8, keep=100, queries=asked).select("id", "other_id", F.round("cosine", 6).alias("cosine"), "place")


def _contents(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    memories = newest(table(spark, folder, "memories").select("id", "content", "updated_at", "version"), "id", ["content"], _NEWEST)
    requests = newest(table(spark, folder, "remember_requests").select("request_id", "content", "received_at"), "request_id", ["content"], ["received_at"])
    return [("memories", memories.toDF("record_id", "text")), ("remember_requests", requests.toDF("record_id", "text"))]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_spans(_contents(spark, folder)).select("table_name", "record_id", "kind", "start_at")


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(_contents(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(copies.record_keys(table(spark, folder, "memories"), "id", "content", _NEWEST))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.record_counts(copies.record_keys(table(spark, folder, "memories"), "id", "content", _NEWEST))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "memories")).select(F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every memory with a near-duplicate, with the group it belongs to and the number of texts it is linked with."""
    return near.near_groups(table(spark, folder, "memories")).select(F.col("id").alias("memory_id"), "group_id", "links")


def p6_ball(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "memories"), method="ball").select(F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("doc_id").cast("bigint").alias("doc_id"), "item_id").distinct()


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item: documents, and words to remove from them."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.col("end_word") - F.col("start_word")).alias("words"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixed(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[1]


def p8_plan(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mixed(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[0]


def _subjects(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [r[0] for r in table(spark, folder, "subjects").select("subject").distinct().collect()]
    return table(spark, folder, "documents"), table(spark, folder, "subject_labels"), names


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects_of(*_subjects(spark, folder)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per subject, and what the posteriors expect."""
    rows = subjects.subject_posteriors(*_subjects(spark, folder))
    return rows.groupBy("subject").agg(F.count_if(F.col("posterior") >= 0.5).alias("documents"), F.round(F.sum("posterior"), 3).alias("expected"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_nearest": p2_nearest, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_groups": p6_groups, "p6_ball": p6_ball, "p7_found": p7_found, "p7_items": p7_items, "p8_plan": p8_plan, "p8_shares": p8_shares, "p9_found": p9_found, "p9_composition": p9_composition}
