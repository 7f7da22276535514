"""Duplicates hidden by formatting differences: one record for texts that differ only in looks.

Texts become a 256-bit key of what is left when looks are ignored, so that only ids and keys are shuffled. Keys
held by many rows are found exactly, from counts combined before the shuffle; their rows are salted and
aggregated in two levels, all others in one shuffle. The representative is the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.llm.canonical import composed, field_list, folded, letters_and_digits
from memlode.runtime import cut, kept
from memlode.sources.parquet import newest


def _hash(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def record_keys(rows: DataFrame, id_column: str, text_column: str, order: list[str]) -> DataFrame:
    """(id, record): the newest row of each id with the key of the record that its text is.

    Two texts are one record if their letters and digits agree in order, or if both are lists of two or more
    labelled fields that agree but for the order of fields. Both rules together are an equivalence, so a text
    that is not a field list but has the letters of one joins that list's record. Null texts get no record; the
    empty text and texts without any letter or digit are one record.
    """
    base = rows.select(F.col(id_column).cast("string").alias("id"), folded(composed(F.col(text_column))).alias("_text"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    keyed = base.select("id", *[f"_order{i}" for i in range(len(order))], *text_keys(F.col("_text")))
    slim = kept(newest(keyed, "id", ["plain", "fields"], [f"_order{i}" for i in range(len(order))]).where("plain is not null"), "records")
    # a third of all rows may share one plain key: the map's side has one row per key, so AQE can split the other
    return slim.select("id", "plain").join(listed_records(slim), "plain", "left").select("id", F.coalesce("record", "plain").alias("record"))


def text_keys(text: Column, letters: Column | None = None, bits: int = 256) -> list[Column]:
    """Keys of a composed and folded text: ``plain`` of its letters and digits (``letters`` if they are known), ``fields`` of its field list (null if it is none)."""
    key = _hash if bits == 256 else lambda c: F.unhex(F.md5(c))
    return [key(letters_and_digits(text) if letters is None else letters).alias("plain"), key(field_list(text)).alias("fields")]


def listed_records(keyed: DataFrame) -> DataFrame:
    """(plain, record): the record of every plain key that some field list has. ``keyed``: (plain, fields) as made by ``text_keys``.

    Texts with fields are few, and their keys are combined before the shuffle.
    """
    links = keyed.where("fields is not null").select("plain", "fields").distinct()
    lists = links.groupBy("plain").agg(F.min("fields").alias("record"), F.max("fields").alias("_other"))
    if lists.where("record <> _other").isEmpty():
        return lists.select("plain", "record")
    return _settled(links)  # one letter sequence, several lists: settle which lists are one record


def _settled(links: DataFrame) -> DataFrame:
    """Smallest field list in each connected component of (plain, fields): labels spread until none changes."""
    state = cut(links.withColumn("record", F.col("fields")))
    while True:
        by_plain = state.groupBy("plain").agg(F.min("record").alias("_a"))
        by_fields = state.join(by_plain, "plain").groupBy("fields").agg(F.min("_a").alias("_b"))
        after = cut(state.join(by_fields, "fields").select("plain", "fields", F.col("_b").alias("record"), (F.col("_b") < F.col("record")).alias("_moved")))
        state = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return state.groupBy("plain").agg(F.min("record").alias("record"))


def _split(keys: DataFrame, hot_rows: int, most_hot: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with at least ``hot_rows`` rows, and all other rows.

    ``hot_rows`` grows with the table so that there are at most ``most_hot`` hot keys: what is broadcast is bounded.
    """
    hot_rows = max(hot_rows, -(-keys.count() // most_hot))
    hot = F.broadcast(keys.groupBy("record").agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows).select("record"))
    return keys.join(hot, "record", "left_semi"), keys.join(hot, "record", "left_anti")


def record_counts(keys: DataFrame, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """(keep_id, copies): one row per record with the number of its copies, itself included."""
    hot, rest = _split(keys, hot_rows)
    salted = hot.groupBy("record", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("_salt")).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    both = salted.groupBy("record").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    return both.select("keep_id", "copies").unionByName(rest.groupBy("record").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).select("keep_id", "copies"))


def copies(keys: DataFrame, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """(keep_id, copy_id): every row that is a copy, with the smallest id of its record.

    Hot records: two-level aggregation finds their smallest id, which is broadcast to their rows, so no task
    holds a whole record. All others: one shuffle, the smallest id over a window of fewer than ``hot_rows`` rows.
    """
    hot, rest = _split(keys, hot_rows)
    salted = hot.groupBy("record", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("_salt")).agg(F.min("id").alias("keep_id"))
    keepers = F.broadcast(salted.groupBy("record").agg(F.min("keep_id").alias("keep_id")))
    from_hot = hot.join(keepers, "record").select("keep_id", F.col("id").alias("copy_id"))
    from_rest = rest.select(F.min("id").over(Window.partitionBy("record")).alias("keep_id"), F.col("id").alias("copy_id"))
    return from_hot.unionByName(from_rest).where("keep_id <> copy_id")
