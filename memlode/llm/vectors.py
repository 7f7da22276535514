"""Most similar vectors for every vector: cells, score-aware anisotropic quantisation, four-bit tables, exact reranking.

1. A bounded sample (parameter ``sample``) trains cells in two levels (spherical k-means, and k-means of what is left
   around the nearest centre, shared by all of them) and product-quantisation codebooks of 16 entries per two
   dimensions. The quantisation error along the vector costs more than the error across it, since only the former
   changes high inner products. The number of cells grows with the square root of the rows.
2. Every vector of the table gets its codes (four bits per two dimensions) and its nearest cells. Its codes go
   to ``spread`` cells; the vector itself, as a query, goes to its nearest cell only.
3. A task per block of a cell scans its codes by tables: each query has a table of its inner products with the 16
   entries of every block, in eight bits, whose entries are looked up by the packed codes and added up; the best
   ``keep`` stay.
4. The candidates are scored exactly from the full vectors and cut to k.

Equal vectors travel as one (their ids come back at the end), so a vector shared by a third of all rows costs one
row per task; cells with more than ``block_rows`` rows are divided into blocks, whose pairs are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.runtime import kept
from memlode.sources.parquet import newest


@dataclass
class Quantiser:
    """Cells: each of ``cells`` (unit vectors) plus each of ``rests``; codebooks (blocks, 16, width). ``parallel``: cost of the error along the vector, 1 across it."""

    cells: np.ndarray
    books: np.ndarray
    parallel: float
    rests: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))

    def places(self, x: np.ndarray, many: int) -> np.ndarray:
        """The nearest ``many`` cells of each vector, nearest first."""
        near = x @ self.cells.T
        if len(self.rests) == 1:
            return _best(near, many)
        heads = _best(near, 4 * many)
        level = 2 * (self.cells @ self.rests.T) + (self.rests**2).sum(1)  # what the rest changes of the squared length
        fine = 2 * (np.take_along_axis(near, heads, 1)[:, :, None] + (x @ self.rests.T)[:, None, :]) - level[heads]
        pick = _best(fine.reshape(len(x), -1), many)
        return np.take_along_axis(heads, pick // len(self.rests), 1) * len(self.rests) + pick % len(self.rests)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables (queries, bytes, 256) of eight-bit entries, step of each query, offset of each query).

        A byte of packed codes stands for two blocks, so its 256 entries are the sums of theirs. The sum of a
        code's entries times the step plus the offset is its inner product with the query, to half a step per byte.
        """
        blocks, _, width = self.books.shape
        plain = np.einsum("nbw,bkw->nbk", queries.reshape(len(queries), blocks, width), self.books, optimize=True)
        pairs = (plain[:, ::2, :, None] + plain[:, 1::2, None, :]).reshape(len(queries), blocks // 2, 256)
        low = pairs.min(2, keepdims=True)
        step = np.maximum((pairs.max(2) - low[:, :, 0]).max(1), 1e-12) / 255
        return np.rint((pairs - low) / step[:, None, None]).astype(np.uint8), step, low.sum((1, 2))

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, blocks) by coordinate descent on the anisotropic loss, from the plain nearest entries."""
        blocks, _, width = self.books.shape
        parts = x.reshape(len(x), blocks, width)
        norms = (self.books**2).sum(2)
        codes = np.empty((len(x), blocks), np.int64)
        dots = np.einsum("nbw,bkw->bnk", parts, self.books, optimize=True)  # entry times part, for every block
        for b in range(blocks):
            codes[:, b] = (norms[b] - 2 * dots[b]).argmin(1)
        own = (parts**2).sum(2)
        along = (own - np.stack([dots[b][np.arange(len(x)), codes[:, b]] for b in range(blocks)], 1)).sum(1)  # residual . x
        for _ in range(rounds):
            for b in range(blocks):
                now = own[:, b] - dots[b][np.arange(len(x)), codes[:, b]]
                after = (along - now)[:, None] + own[:, b][:, None] - dots[b]
                cost = norms[b] - 2 * dots[b] + (self.parallel - 1) * after**2
                codes[:, b] = cost.argmin(1)
                along = after[np.arange(len(x)), codes[:, b]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        blocks, _, width = self.books.shape
        return self.books[np.arange(blocks), codes].reshape(len(codes), blocks * width)


def _best(scores: np.ndarray, many: int) -> np.ndarray:
    """Places of the ``many`` highest scores of each row, highest first."""
    many = min(many, scores.shape[1])
    top = np.argpartition(-scores, many - 1, axis=1)[:, :many]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)


def _spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres.astype(np.float32)


def _rests(x: np.ndarray, centres: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """``many`` centres of what is left of the vectors around their nearest cells (plain k-means)."""
    if many < 2:
        return np.zeros((1, x.shape[1]), np.float32)
    left = x - centres[np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])]
    made = left[rng.choice(len(left), many, replace=len(left) < many)].copy()
    for _ in range(10):
        nearest = (2 * left @ made.T - (made**2).sum(1)).argmax(1)
        sums, counts = np.zeros_like(made), np.bincount(nearest, minlength=many)
        np.add.at(sums, nearest, left)
        made = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], made)
    return made.astype(np.float32)


def train(x: np.ndarray, cells: int, block_width: int = 2, threshold: float = 0.2, rounds: int = 3, seed: int = 7, rests: int = 1, part_rows: int = 8000) -> Quantiser:
    """Fits ``cells`` x ``rests`` cells and codebooks to unit vectors. ``threshold``: inner products above it are those that matter; ``part_rows``: vectors that the codebooks are fitted to."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    blocks = dims // block_width
    parallel = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    books = np.empty((blocks, 16, block_width), np.float32)
    part = x[rng.choice(len(x), min(len(x), part_rows), replace=False)]
    for b in range(blocks):
        p = part[:, b * block_width : (b + 1) * block_width]
        c = p[rng.choice(len(p), 16, replace=len(p) < 16)].copy()
        for _ in range(8):
            nearest = ((c**2).sum(1) - 2 * p @ c.T).argmin(1)
            counts = np.bincount(nearest, minlength=16)
            for w in range(block_width):
                total = np.bincount(nearest, p[:, w], minlength=16)
                c[:, w] = np.where(counts > 0, total / np.maximum(counts, 1), c[:, w])
        books[b] = c
    centres = _spherical_kmeans(x, min(cells, len(x)), rng)
    made = Quantiser(centres, books, parallel, _rests(x, centres, rests, rng))
    for _ in range(rounds):  # codebooks that minimise the anisotropic loss for the current codes: one linear system over all entries
        codes = made.encode(part).astype(np.int64)
        column = ((np.arange(blocks) * 16 + codes)[:, :, None] * block_width + np.arange(block_width)).reshape(len(part), dims)
        size = blocks * 16 * block_width
        left, right = np.zeros((size, size)), np.zeros(size)
        for s in range(0, len(part), 500):
            c, v = column[s : s + 500], part[s : s + 500].astype(np.float64)
            cross = (parallel - 1) * v[:, :, None] * v[:, None, :] / np.maximum((v**2).sum(1), 1e-12)[:, None, None]
            cross[:, np.arange(dims), np.arange(dims)] += 1
            left += np.bincount((c[:, :, None] * size + c[:, None, :]).ravel(), cross.ravel(), minlength=size * size).reshape(size, size)
            right += np.bincount(c.ravel(), (parallel * v).ravel(), minlength=size)
        left[np.arange(size), np.arange(size)] += 1e-6
        made = Quantiser(made.cells, np.linalg.solve(left, right).astype(np.float32).reshape(blocks, 16, block_width), parallel, made.rests)
    return made


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f4").reshape(len(column), dims)


def _place(shared, spread: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser, seen = shared.value, set()
        dims = quantiser.cells.shape[1]
        for batch in batches:
            batch = batch[[h not in seen and not seen.add(h) for h in batch["vec"]]]
            for s in range(0, len(batch), 4096):
                part = batch.iloc[s : s + 4096]
                x = _matrix(part["unit"], dims)
                codes, top = quantiser.encode(x), quantiser.places(x, spread)
                yield pd.DataFrame({"vec": part["vec"].to_numpy(), "unit": part["unit"].to_numpy(), "code": [c.tobytes() for c in (codes[:, ::2] << 4 | codes[:, 1::2])], "cells": list(top.astype(np.int32))})

    return run


def _scan(shared, keep: int, floor: float, error: float, k: int):
    """Best ``keep`` by the tables. Where more than ``keep`` could be wanted, the query comes back without ``other``: its block is to be scored exactly."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        quantiser = shared.value
        dims = quantiser.cells.shape[1]
        pdf = pdf.drop_duplicates(["vec", "is_query"])
        queries, base = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        out = []
        if len(queries) and len(base):
            packed = np.frombuffer(b"".join(base["data"]), np.uint8).reshape(len(base), -1).astype(np.intp)
            ids = base["vec"].to_numpy(np.int64)
            asked, own = _matrix(queries["data"], dims), queries["vec"].to_numpy(np.int64)
            step = max(1, min(512, 4_000_000 // len(base)))
            for s in range(0, len(asked), step):
                tables, size, offset = quantiser.tables(asked[s : s + step])
                sums = np.zeros((len(tables), len(base)), np.uint16 if packed.shape[1] <= 257 else np.uint32)
                for column in range(packed.shape[1]):
                    sums += np.take(tables[:, column], packed[:, column], axis=1)
                scores = sums * size[:, None].astype(np.float32) + offset[:, None].astype(np.float32)
                scores[own[s : s + step][:, None] == ids] = -9
                if len(ids) > keep:
                    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                    high = np.take_along_axis(scores, top, 1)
                    best = -np.partition(-high, min(k, keep - 1), axis=1)[:, min(k, keep - 1)]
                    dense = high.min(1) > np.maximum(floor, best - 2 * error)
                else:
                    top, high = np.broadcast_to(np.arange(len(ids)), scores.shape), scores
                    dense = np.zeros(len(scores), bool)
                q, c = np.nonzero((high > floor) & ~dense[:, None])
                out.append(pd.DataFrame({"query": own[s : s + step][q], "other": ids[top[q, c]]}))
                out.append(pd.DataFrame({"query": own[s : s + step][dense], "other": pd.Series([None] * int(dense.sum()), dtype="Int64")}))
        found = pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        return found.astype({"other": "Int64"}).assign(cell=pdf["cell"].iloc[0], db=pdf["db"].iloc[0], qb=pdf["qb"].iloc[0])

    return run


def _scan_exactly(dims: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["vec", "is_query"])
        queries, base = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})]
        if len(queries) and len(base):
            entries, ids = _matrix(base["data"], dims), base["vec"].to_numpy(np.int64)
            asked, own = _matrix(queries["data"], dims), queries["vec"].to_numpy(np.int64)
            step, most = max(1, 4_000_000 // len(base)), min(k + 2, len(ids))  # a little more than k: single precision
            for s in range(0, len(asked), step):
                scores = asked[s : s + step] @ entries.T
                scores[own[s : s + step][:, None] == ids] = -9
                top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                q, c = np.nonzero(np.take_along_axis(scores, top, 1) > -9)
                out.append(pd.DataFrame({"query": own[s : s + step][q], "other": ids[top[q, c]]}))
        return pd.concat(out)

    return run


def _exact(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = (_matrix(batch["ua"], dims).astype(np.float64) * _matrix(batch["ub"], dims)).sum(1)
            yield pd.DataFrame({"query": batch["query"].to_numpy(), "other": batch["other"].to_numpy(), "score": score})

    return run


def _units(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [v is not None and len(v) == dims for v in batch["vector"]]
            batch = batch[fits]
            x = np.array([np.asarray([np.nan if c is None else c for c in v] if v.dtype == object else v, dtype=np.float64) for v in batch["vector"]]).reshape(len(batch), dims)
            with np.errstate(invalid="ignore", over="ignore"):
                top = np.abs(x).max(1, initial=0)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good][:, None]
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
            yield pd.DataFrame({"id": batch["id"].to_numpy()[good], "unit": pd.Series([row.tobytes() for row in x], dtype=object)})

    return run


def nearest(rows: DataFrame, id_column: str, vector_column: str, order: list[str], k: int = 5, dims: int = 64, least: float | None = None, spread: int = 4, keep: int = 40, slack: float = 0.2, sample: int = 24_000, cells: int | None = None, block_rows: int = 20_000, queries: DataFrame | None = None) -> DataFrame:
    """(id, other_id, cosine, place): the k rows of highest cosine to each row, by the index described above.

    ``least``: only pairs of at least this cosine are wanted; the table scan then drops what lies more than
    ``slack`` below. ``queries``: a DataFrame with a column id, to ask for those rows only; otherwise all ask.
    ``spread``, ``keep``: accuracy; see README.md for the recall measured against brute force. ``cells``: number
    of cells, else twice the square root of the rows; the sample trains one cell of the first level for eight of
    its vectors at most, whatever more is needed comes from the second level. What is broadcast is the codebooks
    and both levels, which the sample bounds.
    Ties are ordered by id. Defined cases: vectors that are null, of another length, zero or not finite take no
    part; repeated rows of an id count once, the newest; an empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).alias("vector"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    orders = [f"_o{i}" for i in range(len(order))]
    units = newest(slim, "id", ["vector"], orders).mapInPandas(_units(dims), "id string, unit binary").withColumn("vec", F.xxhash64("unit"))
    units = kept(units, "units")
    total = units.count()
    if total < 2:
        return spark.createDataFrame([], "id string, other_id string, cosine double, place int")
    # the same sample on every run: hashes below a bound that leaves about ``sample`` rows
    bound = min(1 << 30, int(sample / total * (1 << 30)) + 1)
    drawn = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound).select("vec", "unit").toPandas().sort_values("vec").drop_duplicates("vec")
    wanted = cells or max(1, int(2 * total**0.5))
    first = max(1, min(wanted, len(drawn) // 8))
    quantiser = train(_matrix(drawn["unit"], dims), first, rests=-(-wanted // first))
    shared = spark.sparkContext.broadcast(quantiser)
    placed = kept(units.select("vec", "unit").mapInPandas(_place(shared, spread), "vec bigint, unit binary, code binary, cells array<int>"), "placed")
    asking = placed
    if queries is not None:
        asking = placed.join(units.join(queries.select(F.col("id").cast("string").alias("id")), "id", "left_semi").select("vec").distinct(), "vec", "left_semi")
    spreads = placed.select("vec", "code", F.explode("cells").alias("cell"))
    # cells of more than a block: at most spread x rows / block_rows of them, a bounded broadcast
    large = kept(spreads.groupBy("cell").count().where(F.col("count") > block_rows).select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias("_blocks")), "cells")
    divided = lambda df: df.join(F.broadcast(large), "cell", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("vec"), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    base = divided(spreads).select("vec", F.col("code").alias("data"), "cell", mine.alias("db"), every.alias("qb"), F.lit(False).alias("is_query"))
    # data rows spread over several cells, so a query visits its nearest cell only; single rows that ask visit all their cells
    visits = F.explode("cells").alias("cell") if queries is not None else F.element_at("cells", 1).alias("cell")
    ask = divided(asking.select("vec", F.col("unit").alias("data"), visits)).select("vec", "data", "cell", every.alias("db"), mine.alias("qb"), F.lit(True).alias("is_query"))
    floor = -2.0 if least is None else least - slack
    # the error of a score by codes: for thresholds everything above the floor counts, else the largest of a part of the sample
    part = _matrix(drawn["unit"], dims)[:2000]
    error = 2.0 if least is not None else float(np.abs((part - quantiser.decode(quantiser.encode(part))) @ part.T).max())
    by_codes = kept(base.unionByName(ask).groupBy("cell", "db", "qb").applyInPandas(_scan(shared, keep, floor, error, k), "query bigint, other bigint, cell int, db int, qb int"), "scanned")
    found = by_codes.where("other is not null").select("query", "other")
    dense = by_codes.where("other is null").select("cell", "db", "qb", F.col("query").alias("vec"))
    if not dense.isEmpty():  # only these blocks' full vectors travel
        units_of = placed.select("vec", F.col("unit").alias("data"))
        again = base.select("vec", "cell", "db", "qb").join(dense.select("cell", "db", "qb").distinct(), ["cell", "db", "qb"], "left_semi").join(units_of, "vec").withColumn("is_query", F.lit(False))
        again = again.unionByName(dense.join(units_of, "vec").withColumn("is_query", F.lit(True)))
        found = found.unionByName(again.groupBy("cell", "db", "qb").applyInPandas(_scan_exactly(dims, k), "query bigint, other bigint"))
    found = found.distinct()
    full = placed.select("vec", "unit").dropDuplicates(["vec"])
    both = found.join(full.select(F.col("vec").alias("query"), F.col("unit").alias("ua")), "query").join(full.select(F.col("vec").alias("other"), F.col("unit").alias("ub")), "other")
    scored = both.mapInPandas(_exact(dims), "query bigint, other bigint, score double")
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    close = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other"))).where(F.col("_r") <= k + 1).select("query", "other", "score")
    return _with_ids(units, close, k, least, queries)


def _with_ids(units: DataFrame, close: DataFrame, k: int, least: float | None, queries: DataFrame | None) -> DataFrame:
    """From vectors to ids: of each vector only its k + 1 smallest ids can be among anyone's k nearest."""
    named = units.select("id", "vec")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k + 1).groupBy("vec").agg(F.collect_list("id").alias("ids"))
    same = first.where(F.size("ids") > 1).select(F.col("vec").alias("query"), F.col("ids"), F.lit(1.0).alias("score"))
    others = close.join(first, F.col("other") == F.col("vec")).select("query", "ids", "score")
    lists = others.unionByName(same).groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("ids"))).alias("near"))  # at most k + 2 entries
    asking = named if queries is None else named.join(queries.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    joined = asking.join(lists, F.col("vec") == F.col("query")).select("id", "near")
    flat = F.array_sort(F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(n["minus"].alias("minus"), i.alias("other_id"))))))
    best = F.slice(F.filter(flat, lambda x: x["other_id"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(best).alias("place", "_x")).select("id", F.col("_x.other_id").alias("other_id"), (-F.col("_x.minus")).alias("cosine"), (F.col("place") + 1).alias("place"))


def similar_pairs(rows: DataFrame, id_column: str, vector_column: str, order: list[str], least: float, k: int = 5, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of cosine ``least`` or more of which one is among the k nearest of the other."""
    near = nearest(rows, id_column, vector_column, order, k=k, least=least, **options)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
