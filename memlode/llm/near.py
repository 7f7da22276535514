"""Near-duplicate records: small edits, insertions or reordering, found without comparing all pairs.

Two ways to candidates, both verified exactly on word sequences ("shingles"):

* ``prefix_pairs`` (used by the query): shingles in one global order from rare to frequent; two records of
  similarity s or more must share a shingle among the first n - ceil(s n) + 1 of each, so only those are shuffled.
  Every pair is found, whatever the order; the order only decides how few candidates there are.
* ``ball_pairs``: meet-in-the-middle ball hashing of 64-bit fingerprints. Every fingerprint emits all variants
  within half the radius, the variants are shuffled, colliding pairs are verified. It finds exactly the pairs
  within the radius, which suits similarities near 1; README.md has the figures for lower ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlode.llm.canonical import composed, folded, words
from memlode.llm.copies import listed_records, text_keys
from memlode.operators.graph import components
from memlode.runtime import kept
from memlode.sources.parquet import newest


def shingles(tokens: Column, size: int) -> Column:
    """Distinct 64-bit hashes of all runs of ``size`` words; empty if there are fewer words."""
    last = F.size(tokens) - size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def sketches(rows: DataFrame, id_column: str, group_column: str, text_column: str, order: list[str], size: int = 3) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, owner, kind, plain, fields, grams), kept in the shared folder, and (id, kind) of the newest row of each id.

    ``kind`` is equal for rows of one group with equal keys (as in ``copies.text_keys``) and equal shingles, which
    therefore have the same partners.
    """
    orders = [f"_o{i}" for i in range(len(order))]
    sound = rows.where(F.col(id_column).isNotNull() & F.col(group_column).isNotNull() & F.col(text_column).isNotNull())
    base = sound.select(F.col(id_column).cast("string").alias("id"), F.col(group_column).cast("string").alias("owner"), folded(composed(F.col(text_column))).alias("_text"), *[F.col(c).alias(o) for c, o in zip(order, orders, strict=True)])
    # columns that several expressions need are selected first: an expression repeated inside a lambda runs once per element
    made = base.select("id", "owner", "_text", words(F.col("_text")).alias("_words"), *orders)
    plain, fields = text_keys(F.col("_text"), F.array_join("_words", ""), bits=128)
    made = made.select("id", "owner", plain, fields, shingles(F.col("_words"), size).alias("grams"), *orders).withColumn("_sorted", F.sort_array("grams"))
    same = [F.xxhash64(F.lit(seed), "_sorted").cast("string") for seed in (1, 2)]
    made = made.withColumn("kind", F.unhex(F.md5(F.concat("plain", F.coalesce("fields", F.lit(b"")), F.encode(F.concat_ws("|", "owner", *same), "UTF-8"))))).drop("_sorted")
    table = kept(made, "sketches")
    # several rows of one id: only ids and what decides travel, and only of rows that hold
    latest = newest(table.select("id", "kind", *orders), "id", ["kind"], orders)
    return table.drop(*orders), latest


def _local_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles that occur in several records of a batch, with their counts: the map-side half of a heavy-hitter count."""
    for batch in batches:
        if len(batch):
            values, counts = np.unique(np.concatenate([np.asarray(g, dtype=np.int64) for g in batch["grams"]]), return_counts=True)
            yield pd.DataFrame({"gram": values[counts > 1], "n": counts[counts > 1].astype(np.int64)})


def frequent_grams(table: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` shingles that repeat most within batches over all rows, and their counts (16 bytes each on the driver).

    The least count that leaves no more than ``most`` shingles is found from a histogram of counts, so no task sends
    more than it has above it.
    """
    counts = kept(table.select("grams").mapInPandas(_local_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    steps = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows
    taken, least = 0, 0
    for row in steps:
        taken += row["count"]
        if taken > most:
            least = row["step"] + 1
            break
    top = counts.where(F.floor(8 * F.log2("n")) >= least).toPandas().sort_values("gram")
    return top["gram"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers, any would do


def _prefixes(known, similarity: float, block: int):
    grams_known, counts_known = known.value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # kinds this task has emitted: copies are combined before the shuffle
        for batch in batches:
            fresh = [k not in seen and not seen.add(k) for k in batch["kind"]]
            batch = batch[fresh]
            sizes = batch["grams"].map(len).to_numpy(np.int64)
            batch, sizes = batch[sizes > 0], sizes[sizes > 0]
            if not len(batch):
                continue
            grams = np.concatenate([np.asarray(g, dtype=np.int64) for g in batch["grams"]])
            doc = np.repeat(np.arange(len(batch)), sizes)
            at = np.minimum(np.searchsorted(grams_known, grams), max(len(grams_known) - 1, 0))
            freq = np.where(grams_known[at] == grams, counts_known[at], 0) if len(grams_known) else np.zeros(len(grams), np.int64)
            order = np.lexsort((grams, freq, doc))
            place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            short = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            chosen = order[place < np.repeat(short, sizes)]
            owners = batch["owner_hash"].to_numpy(np.int64).astype(np.uint64)[doc[chosen]]
            keys = (grams[chosen].astype(np.uint64) * _MIX_A) ^ (owners * _MIX_B)
            yield pd.DataFrame({"key": keys.astype(np.int64), "kind": batch["kind"].to_numpy()[doc[chosen]], "n": sizes[doc[chosen]].astype(np.int32), "often": freq[chosen] >= block})

    return run


def _hot_keys(rows: DataFrame, block: int) -> DataFrame:
    """(key, _n) of keys with more than ``block`` rows, from counts combined before the shuffle; kept, so that Spark knows the table's size."""
    return kept(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block), "hot")


def _met(rows: DataFrame, columns: list[str], block: int = 10_000, hot: DataFrame | None = None) -> DataFrame:
    """Pairs of kinds that share a ``key``: (a, b and the other columns of each side with the suffixes _a, _b), a < b.

    Rows are shuffled by key once and duplicates of (key, kind) dropped where they are. Keys of more than ``block``
    rows (``hot``, else counted here) are divided into blocks that meet pair by pair in separate tasks, so no task
    joins such a key whole but up to 10^8 pairs of rows. All joins spill.
    """
    hot = _hot_keys(rows, block) if hot is None else hot
    side = lambda df, x: df.select(*[c for c in df.columns if c not in ("kind", *columns)], F.col("kind").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    some = not hot.isEmpty()
    few = (rows.join(hot, "key", "left_anti") if some else rows).repartition("key").dropDuplicates(["key", "kind"])
    out = side(few, "a").join(side(few, "b").hint("merge"), "key").where("a < b").drop("key")
    if not some:
        return out
    count = F.ceil(F.col("_n") / block).cast("int")
    many = rows.join(hot, "key").dropDuplicates(["key", "kind"]).withColumn("_k", F.pmod(F.xxhash64("kind"), count).cast("int")).withColumn("_blocks", count).drop("_n")
    left = side(many.withColumns({"_i": F.col("_k"), "_j": F.explode(F.sequence(F.col("_k"), F.col("_blocks") - 1))}).drop("_k", "_blocks"), "a")
    right = side(many.withColumns({"_j": F.col("_k"), "_i": F.explode(F.sequence(F.lit(0), F.col("_k")))}).drop("_k", "_blocks"), "b")
    met = left.join(right.hint("merge"), ["key", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("a") < F.col("b"))).drop("key", "_i", "_j")
    turned = met.select(*[F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q)).alias(p) for c in ("", *columns) for p, q in ((f"{c}_a", f"{c}_b") if c else ("a", "b"), (f"{c}_b", f"{c}_a") if c else ("b", "a"))])
    return out.unionByName(turned)


def prefix_pairs(table: DataFrame, similarity: float, block: int = 10_000) -> DataFrame:
    """Candidate pairs (a, b), a < b, of 64-bit hashes of kinds: those that share enough of their prefixes to reach ``similarity``.

    Two kinds of one hash would only add a candidate, since ``verified`` looks at the kinds themselves.

    Lengths must fit, and the number of shared prefix shingles plus all that lies beyond the longer remainder
    must reach the needed overlap; both tests drop no true pair. Copies were combined into kinds before, so a
    text held by a third of all rows emits its prefix once per task. A key shared by many *different* records of
    one group is divided into blocks (``_met``).
    """
    spark = table.sparkSession
    known = spark.sparkContext.broadcast(frequent_grams(table))
    rows = table.select(F.xxhash64("kind").alias("kind"), F.xxhash64("owner").alias("owner_hash"), "grams").mapInPandas(_prefixes(known, similarity, block), "key bigint, kind bigint, n int, often boolean")
    # only a shingle that is frequent over all rows can be hot in one group; one that no batch holds twice is held by as many rows as there are batches at most
    hot = _hot_keys(rows.where("often"), block)
    rows = rows.drop("often")
    fits = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9
    shared = _met(rows, ["n"], block, hot).where(fits).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    beyond = F.greatest(F.ceil(F.lit(similarity) * F.col("n_a") - 1e-9), F.ceil(F.lit(similarity) * F.col("n_b") - 1e-9)) - 1
    return shared.where(F.col("common") + beyond >= needed).select("a", "b")


def _fingerprints(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shifts = np.arange(bits, dtype=np.uint64)
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch[[k not in seen and not seen.add(k) for k in batch["kind"]]]
            prints = []
            for grams in batch["grams"]:
                ones = ((np.asarray(grams, dtype=np.int64).astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).sum(axis=0)
                prints.append(int((np.where(2 * ones > max(len(grams), 1), np.uint64(1), np.uint64(0)) << shifts).sum(dtype=np.uint64).astype(np.int64)))
            yield pd.DataFrame({"kind": batch["kind"].to_numpy(), "owner_hash": batch["owner_hash"].to_numpy(), "print": np.array(prints, dtype=np.int64)})

    return run


def ball_pairs(table: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Candidate pairs of kinds (a, b), a < b, of one group whose similarity fingerprints differ in at most ``radius`` bits.

    Each fingerprint emits every variant within half the radius (rounded up), 1 + bits + ... of them; two
    fingerprints within the radius meet in at least one variant. The pairs are deduplicated and their distance
    is checked before anything else is joined.
    """
    half = (radius + 1) // 2
    masks = [sum(1 << i for i in chosen) for r in range(half + 1) for chosen in combinations(range(bits), r)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    prints = table.select("kind", F.xxhash64("owner").alias("owner_hash"), "grams").where("size(grams) > 0").mapInPandas(_fingerprints(bits), "kind binary, owner_hash bigint, print bigint")
    prints = kept(prints.dropDuplicates(["kind"]), "prints")
    variants = prints.select("kind", "print", F.explode(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.xxhash64(F.col("owner_hash"), F.col("print").bitwiseXOR(m)))).alias("key"))
    near = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= radius
    return _met(variants, ["print"]).where(near).select("a", "b").distinct()


def verified(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """Pairs of kinds (a, b) of one group and different records whose distinct shingles overlap in ``similarity`` of the union or more; ``pairs`` of their 64-bit hashes."""
    pairs = kept(pairs, "pairs")  # narrow: two numbers each
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_h")).distinct().hint("merge")  # its size has no bound: never broadcast
    # texts are shuffled once: the same partitions serve to pick those in pairs, to drop copies and for both sides of the join
    texts = table.select(F.xxhash64("kind").alias("_h"), "kind", "owner", "plain", "grams").join(ends, "_h", "left_semi").dropDuplicates(["_h", "kind"])
    left, right = [texts.select(F.col("_h").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("kind", "owner", "plain", "grams")]) for x in "ab"]
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    joined = pairs.join(left, "a").join(right, "b").where("owner_a = owner_b and plain_a <> plain_b")
    close = joined.where(both >= F.lit(similarity) * (F.size("grams_a") + F.size("grams_b") - both) - 1e-9).select("kind_a", "kind_b", "plain_a", "plain_b")
    records = listed_records(table)
    for x in "ab":
        close = close.join(records.select(F.col("plain").alias(f"plain_{x}"), F.col("record").alias(f"record_{x}")), f"plain_{x}", "left")
    differ = F.coalesce("record_a", "plain_a") != F.coalesce("record_b", "plain_b")
    return close.where(differ).select(F.col("kind_a").alias("a"), F.col("kind_b").alias("b"))


def _links(rows: DataFrame, id_column: str, group_column: str, text_column: str, order: list[str] | None, size: int, similarity: float, method: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between kinds (a, b), and (id, kind) of the rows that hold."""
    table, latest = sketches(rows, id_column, group_column, text_column, order or ["updated_at", "version"], size)
    pairs = prefix_pairs(table, similarity) if method == "prefix" else ball_pairs(table, radius).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    return kept(verified(pairs, table, similarity), "links"), latest


def near_duplicates(rows: DataFrame, id_column: str = "id", group_column: str = "entity_id", text_column: str = "content", order: list[str] | None = None, size: int = 3, similarity: float = 0.5, method: str = "prefix", radius: int = 2) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of one group, different records, that share at least ``similarity`` of their word sequences.

    The similarity is of sets: distinct sequences of ``size`` words in both / in either. Defined cases: null id,
    group or text: the row has no partner; texts of fewer than ``size`` words have no sequences and no partner;
    an empty table gives no pairs; repeated rows of an id count once, the newest by ``order``; texts are read
    whole; other columns are ignored. Members of equal texts are listed with each of their partners.
    """
    links, latest = _links(rows, id_column, group_column, text_column, order, size, similarity, method, radius)
    a, b = latest.select(F.col("kind").alias("a"), F.col("id").alias("_x")), latest.select(F.col("kind").alias("b"), F.col("id").alias("_y"))
    return links.join(a, "a").join(b, "b").select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))


def near_groups(rows: DataFrame, id_column: str = "id", group_column: str = "entity_id", text_column: str = "content", order: list[str] | None = None, size: int = 3, similarity: float = 0.5, method: str = "prefix", radius: int = 2) -> DataFrame:
    """(id, class_id, group_id, links): every row with a partner, once, with the smallest id of its group.

    Groups are what pairs of ``near_duplicates`` connect. ``class_id`` is the smallest id among rows that have the
    same partners (copies in one group), ``links`` the number of classes such a row is linked with. The cases of
    ``near_duplicates`` hold here too; rows without a partner don't come out.
    """
    links, latest = _links(rows, id_column, group_column, text_column, order, size, similarity, method, radius)
    classes = latest.groupBy("kind").agg(F.min("id").alias("class_id"))
    named = links.join(classes.select(F.col("kind").alias("a"), F.col("class_id").alias("_a")), "a").join(classes.select(F.col("kind").alias("b"), F.col("class_id").alias("_b")), "b")
    named = kept(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "named")
    counts = named.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = components(named).select(F.col("id").alias("class_id"), "root")
    # a group's id is the smallest id of its members: classes are named by theirs, so the smallest class is it
    members = latest.join(classes, "kind").select("id", "class_id")
    return members.join(groups, "class_id").join(counts, "class_id").select("id", "class_id", F.col("root").alias("group_id"), "links")
