"""A persisted vector index: cells trained on a bounded sample, vectors in Parquet by cell; insert, delete and search.

``build`` writes a version of the index; ``inserted`` and ``deleted`` write the next one, so readers of the old files
aren't disturbed. A search reads the cells nearest to the query only, since the files are partitioned by cell, and
``search_many`` compares each query with its nearest cells in one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import cosine, dot, normalised

_HASHES = 1 << 30


def train_cells(rows: DataFrame, vector: str, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 3) -> list[list[float]]:
    """Unit centres of at most ``cells`` cells by spherical k-means on about ``sample`` vectors, picked by hash: the same on every run."""
    units = rows.select(normalised(F.col(vector)).alias("u")).where("u is not null")
    total = units.count()
    bound = min(_HASHES, int(sample / max(total, 1) * _HASHES) + 1)
    drawn = units.where(F.pmod(F.xxhash64("u"), F.lit(_HASHES)) < bound).toPandas()["u"]
    if not len(drawn):
        return []
    x = np.unique(np.stack(drawn.to_list()), axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near, sums = (x @ centres.T).argmax(1), np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres.tolist()


def nearest_cells(vector: Column, cells: list[list[float]], many: int = 1) -> Column:
    """The ``many`` cells of highest inner product, best first; one matrix product per batch of vectors, all as long as the cells'."""
    centres = np.array(cells)

    @F.pandas_udf("array<int>")
    def near(units: pd.Series) -> pd.Series:
        scores = np.stack(units.to_list()) @ centres.T if len(units) else np.zeros((0, len(centres)))
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :many].astype(np.int32)), index=units.index)

    return near(vector)


def placed(rows: DataFrame, id_column: str, vector: str, cells: list[list[float]]) -> DataFrame:
    """(id, unit, cell): every vector that has a direction and the length of the cells, in its nearest cell; others are left out."""
    units = rows.select(F.col(id_column).alias("id"), normalised(F.col(vector)).alias("unit")).where(F.col("id").isNotNull() & F.col("unit").isNotNull() & (F.size("unit") == len(cells[0])))
    return units.select("id", "unit", F.element_at(nearest_cells(F.col("unit"), cells), 1).alias("cell"))


def build(rows: DataFrame, id_column: str, vector: str, path: str, cells: int = 64, sample: int = 20_000) -> None:
    """Trains the cells and writes vectors and centres under ``path``, which must be new."""
    spark = rows.sparkSession
    made = train_cells(rows, vector, cells, sample)
    if not made:
        raise ValueError("no vector has a direction")
    spark.createDataFrame([(i, c) for i, c in enumerate(made)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    placed(rows, id_column, vector, made).repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]]]:
    """(vectors, centres) of a version; raises if the files don't have the columns and lengths of an index."""
    schema = "id string, unit array<double>, cell int"
    vectors = spark.read.schema(schema).parquet(f"{path}/vectors")
    centres = [list(r["centre"]) for r in spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()]  # as many as there are cells
    if not centres or len({len(c) for c in centres}) != 1 or any(v != v for c in centres for v in c):
        raise ValueError(f"{path} is no sound index")
    return vectors, centres


def _next(spark: SparkSession, vectors: DataFrame, old: str, new: str) -> None:
    spark.read.parquet(f"{old}/centres").coalesce(1).write.parquet(f"{new}/centres")
    vectors.repartition("cell").write.partitionBy("cell").parquet(f"{new}/vectors")


def inserted(rows: DataFrame, id_column: str, vector: str, old: str, new: str) -> None:
    """The next version with rows added; an id that is there already gets the new vector."""
    spark = rows.sparkSession
    vectors, cells = load(spark, old)
    fresh = placed(rows, id_column, vector, cells)
    _next(spark, vectors.join(fresh.select("id"), "id", "left_anti").unionByName(fresh), old, new)


def deleted(ids: DataFrame, old: str, new: str) -> None:
    """The next version without some ids."""
    spark = ids.sparkSession
    vectors, _ = load(spark, old)
    _next(spark, vectors.join(ids.select("id"), "id", "left_anti"), old, new)


def search(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int = 8) -> DataFrame:
    """(id, similarity): the k most similar vectors in the ``probes`` cells nearest to a query; only their files are read."""
    vectors, cells = load(spark, path)
    q = np.asarray(query, dtype=float)
    q = q / max(float(np.linalg.norm(q)), 1e-300)
    near = np.argsort(-(np.array(cells) @ q), kind="stable")[:probes].tolist()
    wanted = F.array(*[F.lit(float(v)) for v in q])
    return vectors.where(F.col("cell").isin(near)).select("id", F.round(cosine(F.col("unit"), wanted), 9).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def search_many(queries: DataFrame, path: str, k: int = 10, probes: int = 8) -> DataFrame:
    """(query, id, similarity): the k most similar vectors of each row of ``queries`` (query, vector), joined by cell."""
    vectors, cells = load(queries.sparkSession, path)
    asked = queries.select("query", normalised(F.col("vector")).alias("_q")).where(F.col("_q").isNotNull() & (F.size("_q") == len(cells[0])))
    probed = asked.select("query", "_q", F.explode(nearest_cells(F.col("_q"), cells, probes)).alias("cell"))
    scored = probed.join(vectors, "cell").select("query", F.struct((-F.round(dot(F.col("unit"), F.col("_q")), 9)).alias("m"), F.col("id")).alias("s"))
    order = Window.partitionBy("query").orderBy("s")
    best = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return best.select("query", F.col("s.id").alias("id"), (-F.col("s.m")).alias("similarity"))

