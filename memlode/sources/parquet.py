"""Tables kept as Parquet: reading, newest versions, defaults, versioned rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.runtime import kept, ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; filters and column choice on it reach the Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def newest(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``key``: ``values`` of the row with the greatest ``order`` columns (nulls lowest).

    Aggregates with a map-side combine instead of a window sort. Ties in ``order`` are broken by the values, so
    the result doesn't depend on row order. Rows with a null key are dropped. Values may be of any type that
    can be compared; columns beyond ``key`` and ``values`` are not read.
    """
    picked = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)]))
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("_picked"))
    return rows.select(key, *[F.col(f"_picked._v{i}").alias(c) for i, c in enumerate(values)])


def newest_of_wide(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``newest``, for rows with long texts or vectors: only rows of ids that occur several times are shuffled.

    Those ids are found from the key column alone and written to the shared folder. As their table's size is known,
    Spark broadcasts it if it is below its threshold and shuffles otherwise; all other rows stay where they are read.
    """
    repeated = kept(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    once = df.where(F.col(key).isNotNull()).join(repeated, key, "left_anti").select(key, *values)
    return once.unionByName(newest(df.join(repeated, key, "left_semi"), key, values, order))


def clean_key(column: Column) -> Column:
    """A reference as it is compared: no white space around it (of any Unicode kind), lower case, null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")), F.lit(""))


def write_version(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> None:
    """Writes a new version of a table; readers of the old files aren't disturbed since the path must be a new one."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{folder}/{name}.parquet")
