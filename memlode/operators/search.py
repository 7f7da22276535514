"""Vector and full-text search, ranking, merging, similarity joins within a group."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlode.functions.columns import at, cosine, normalised
from memlode.operators import scoring
from memlode.operators.filters import has_any_tag

# Words that carry no meaning in a query.
STOP_WORDS = frozenset(("what", "is", "the", "a", "an", "user's", "user", "their", "do", "does", "where", "how", "who", "when", "which", "and", "or", "of", "to", "in", "for", "with", "they", "are", "was", "about", "from", "at", "has", "have", "did", "can", "will", "my", "me", "tell", "know"))


def vector(values: Sequence[float]) -> Column:
    """A query vector as a literal; Catalyst ships it with the plan."""
    return F.array(*[F.lit(float(v)) for v in values])


def similar(memories: DataFrame, query: Column, limit: int, least: float = 0.0) -> DataFrame:
    """The rows of highest cosine to one query, exact. Filter ``memories`` before: a condition then can't cost results."""
    return memories.withColumn("similarity", F.round(cosine(F.col("embedding"), query), 9)).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit)


def first_of_equal_texts(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row per text, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.sha2("content", 256)).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def search(memories: DataFrame, query: Column, now: datetime, mode: str = "balanced", limit: int = 10, least: float = 0.0) -> DataFrame:
    """Composite score over all rows of at least a similarity, equal texts once, best first."""
    rows = memories.withColumn("similarity", cosine(F.col("embedding"), query)).where(F.col("similarity") >= least)
    scored = rows.withColumn("score", F.round(scoring.composite(F.col("similarity"), now, mode), 6))
    order = [F.desc("score"), F.asc("id")]
    return first_of_equal_texts(scored, order).orderBy(*order).limit(limit)


def retrieve(memories: DataFrame, query: Column, now: datetime, limit: int, states: Sequence[str] = ("active", "resolved"), since: datetime | None = None, until: datetime | None = None, any_tags: Sequence[str] = ()) -> DataFrame:
    """The best by retrieval score, of some states, created from ``since`` to ``until`` inclusive and with any of some tags."""
    rows = memories.where(F.col("state").isin(*states))
    if since is not None:
        rows = rows.where(F.col("created_at") >= at(since))
    if until is not None:
        rows = rows.where(F.col("created_at") <= at(until))
    if any_tags:
        rows = rows.where(has_any_tag(any_tags))
    rows = rows.withColumn("similarity", cosine(F.col("embedding"), query))
    return rows.withColumn("score", F.round(scoring.retrieval_score(F.col("similarity"), now), 6)).orderBy(F.desc("score"), "id").limit(limit)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two result lists (id, score) by id with the better score."""
    return first.select("id", "score").unionByName(second.select("id", "score")).groupBy("id").agg(F.max("score").alias("score"))


def tiered(memories: DataFrame, query: Column, text: str | None, limit: int, hot: int = 500, hit: float = 0.7, weak: float = 0.4) -> DataFrame:
    """Per owner: the hottest rows answer if one reaches ``hit``; else all rows do; texts join in if the best is below ``weak``.

    (entity_id, id, score, tier). The tier is a flag per owner, so all owners are answered in one plan.
    """
    base = memories.withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6))
    recency = Window.partitionBy("entity_id").orderBy(F.col("last_accessed_at").desc_nulls_last(), "id")
    ranked = base.withColumn("_hot", F.row_number().over(recency) <= hot)
    best = ranked.groupBy("entity_id").agg(F.max(F.when(F.col("_hot"), F.col("similarity"))).alias("_hot_best"), F.max("similarity").alias("_best"))
    terms = query_terms(text) if text else []
    hits = matches(F.col("content"), terms) if terms else F.lit(False)
    tier = F.when(F.col("_hot_best") >= hit, 1).when((F.col("_best") >= weak) | F.lit(not terms), 2).otherwise(3)
    joined = ranked.join(best, "entity_id").withColumn("tier", tier)
    score = F.when((F.col("tier") == 3) & hits & F.col("embedding").isNull(), 0.3).otherwise(F.col("similarity"))
    usable = F.when(F.col("tier") == 1, F.col("_hot")).when(F.col("tier") == 2, F.lit(True)).otherwise(hits | (F.col("similarity") > 0))
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "id")
    return joined.where(usable).withColumn("score", score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("entity_id", "id", "score", "tier")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """Words of a query that mean something: longer than two letters, no stop words, without punctuation around them."""
    cleaned = [w.strip("?.,!;:'\"") for w in text.lower().split()]
    return [w for w in cleaned if len(w) > 2 and w not in STOP_WORDS]


def query_terms_of(text: Column) -> Column:
    cleaned = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"^[?.,!;:'\"]+|[?.,!;:'\"]+\z", ""))
    return F.filter(cleaned, lambda w: (F.octet_length(w) > 2) & ~w.isin(*sorted(STOP_WORDS)))


def matches(text: Column, terms: Sequence[str]) -> Column:
    """All terms occur as words."""
    words = tokens(text)
    return F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in dict.fromkeys(terms)]))) == len(dict.fromkeys(terms))


def ranked_text(memories: DataFrame, terms: Sequence[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over rows that hold every term: (id, score).

    Only the query's terms are exploded, so what is shuffled is one row per match, not the vocabulary.
    """
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    docs = memories.select("id", tokens(F.col("content")).alias("w")).select("id", F.size("w").alias("length"), F.filter("w", lambda t: F.array_contains(wanted, t)).alias("w"))
    totals = docs.agg(F.count("*").alias("_docs"), F.avg("length").alias("_mean"))
    counts = docs.select("id", "length", F.explode("w").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    spread = counts.groupBy("term").agg(F.count("*").alias("_df"))
    joined = counts.join(F.broadcast(spread), "term").join(F.broadcast(totals))  # one row per term, and one row
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("_mean")))
    scored = joined.groupBy("id").agg(F.sum(weight).alias("s"), F.count("*").alias("n")).where(F.col("n") == len(dict.fromkeys(terms)))
    return scored.select("id", F.round("s", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _pairs(threshold: float, top: int | None, one_side: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"group": [], "a": [], "b": [], "similarity": []}).astype({"group": str, "a": str, "b": str, "similarity": float})
        x, y = np.stack(left["_unit"].to_list()), np.stack(right["_unit"].to_list())
        ids_x, ids_y, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        twice = one_side and pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        for s in range(0, len(x), 512):
            scores = x[s : s + 512] @ y.T
            if one_side:
                scores[ids_x[s : s + 512][:, None] == ids_y] = -9
            if top is not None and scores.shape[1] > top:  # what can't be among the best of its row leaves no task
                edge = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
                i, j = np.nonzero((scores >= edge - 1e-12) & (scores >= threshold - 1e-9))
            else:
                i, j = np.nonzero(scores >= threshold - 1e-9)
            a, b = ids_x[s : s + 512][i], ids_y[j]
            found = pd.DataFrame({"a": a, "b": b, "similarity": scores[i, j]})
            out.append(found[found["a"] < found["b"]] if twice else found)
        pairs = pd.concat(out)
        if one_side:
            swap = (pairs["a"] > pairs["b"]).to_numpy()
            pairs.loc[swap, ["a", "b"]] = pairs.loc[swap, ["b", "a"]].to_numpy()
        return pairs.assign(group=pdf["_g"].iloc[0])[["group", "a", "b", "similarity"]]

    return run


def _units(rows: DataFrame, group: str) -> DataFrame:
    rows = rows.where(F.col("embedding").isNotNull() & F.col(group).isNotNull())
    # a generator computes the vector once; a filter on it would be pushed down and compute it again
    return rows.select("id", F.col(group).alias("_g"), F.size("embedding").alias("_dims"), F.explode(F.array_compact(F.array(normalised(F.col("embedding"))))).alias("_unit"))


def _placed(units: DataFrame, block: int) -> DataFrame:
    """Every row with its block, and how many blocks its group has."""
    blocks = units.groupBy("_g", "_dims").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    return units.join(blocks, ["_g", "_dims"]).withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))


_PAIR_COLUMNS = "group string, a string, b string, similarity double"


def similarity_pairs(memories: DataFrame, group: str, threshold: float, block: int = 2000) -> DataFrame:
    """(a, b, similarity), a < b: rows of a group with a cosine of ``threshold`` or more, exact.

    Groups are compared block against block, each pair of blocks once and a task of at most 2 x ``block`` rows, so a
    large group spreads over many tasks and only pairs over the threshold leave them. For groups too large for
    that, the vector index of the training-data operators finds neighbours without comparing all blocks.
    """
    placed = _placed(_units(memories, group), block)
    left = placed.select("id", "_g", "_dims", "_unit", F.col("_k").alias("_i"), F.explode(F.sequence(F.col("_k"), F.col("_blocks") - 1)).alias("_j"), F.lit(0).alias("_side"))
    right = placed.select("id", "_g", "_dims", "_unit", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"), F.col("_k").alias("_j"), F.lit(1).alias("_side"))
    return left.unionByName(right).groupBy("_g", "_dims", "_i", "_j").applyInPandas(_pairs(threshold, None, True), _PAIR_COLUMNS).select("a", "b", "similarity")


def similarity_between(left: DataFrame, right: DataFrame, group: str, threshold: float, top: int | None = None, block: int = 2000) -> DataFrame:
    """(group, a, b, similarity): rows a of ``left`` with rows b of ``right`` of the same group, of a cosine of ``threshold`` or more; the ``top`` of each a if given, ties by id.

    Only groups that both sides have are compared, block against block; a task sends no more than the best of each row.
    """
    first, second = _placed(_units(left, group), block), _placed(_units(right, group), block)
    sides = first.select("_g", "_dims", F.col("_blocks").alias("_bi")).distinct().join(second.select("_g", "_dims", F.col("_blocks").alias("_bj")).distinct(), ["_g", "_dims"])
    a = first.join(sides, ["_g", "_dims"]).select("id", "_g", "_dims", "_unit", F.col("_k").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_bj") - 1)).alias("_j"), F.lit(0).alias("_side"))
    b = second.join(sides, ["_g", "_dims"]).select("id", "_g", "_dims", "_unit", F.explode(F.sequence(F.lit(0), F.col("_bi") - 1)).alias("_i"), F.col("_k").alias("_j"), F.lit(1).alias("_side"))
    found = a.unionByName(b).groupBy("_g", "_dims", "_i", "_j").applyInPandas(_pairs(threshold, top, False), _PAIR_COLUMNS)
    if top is None:
        return found
    order = Window.partitionBy("group", "a").orderBy(F.round("similarity", 9).desc(), "b")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact (query, id) pairs that were found, per query."""
    hits = exact.join(found.select("query", "id", F.lit(1).alias("_hit")), ["query", "id"], "left")
    return hits.groupBy("query").agg(F.round(F.sum(F.coalesce("_hit", F.lit(0))) / F.lit(k), 6).alias("recall"))
