"""Mixing sources to target weights: soft membership, projected gradient on document rates, capped repeats.

Documents with a known source belong to it; for the others a naive Bayes classifier, trained on those with a known
source, gives the posterior of every source, rounded to tenths. Documents of equal membership share a rate, so the
corpus is first added up to one row per membership (tokens), and the rates between 0 and the source's cap are fitted
on that small table by projected gradient, until the expected tokens of each source stop coming closer to its target.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlode.llm.canonical import folded_text
from memlode.runtime import kept

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are divided before byte pairs are merged, as published with that vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(column: Column) -> Column:
    """Case, blanks around it and hyphens for underscores don't matter; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_"), F.lit(""))


def _ship_tokenizer(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary to all executors; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=2)
def _counter(name: str) -> Callable[[str], int]:
    """Tokens of a text by a vocabulary that was shipped: ranks (.tiktoken) or a tokenizers file (.json)."""
    path = SparkFiles.get(name)
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        made = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(made.encode_ordinary(text))
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


_LETTERS, _LINE_START = re.compile(r"[^\W\d_]+"), re.compile(r"(?:^|\n)([^\n]{0,12})")
_LOWER, _DIGITS = re.compile(r"[^\W\dA-ZÀ-ÖØ-Þ_]+"), re.compile(r"\d+")


def _features(text: str, seen: dict[str, int], buckets: int) -> np.ndarray:
    """Hashed words and the shapes of line beginnings, each once per document: sources differ in layout."""
    import xxhash

    said = set(_LETTERS.findall(folded_text(text)))
    said.update("\n" + _DIGITS.sub("9", _LOWER.sub("a", start)) for start in set(_LINE_START.findall(text)))
    if len(seen) > 500_000:
        seen.clear()
    got = [seen[t] if t in seen else seen.setdefault(t, xxhash.xxh64_intdigest(t) % buckets) for t in said]
    return np.unique(np.array(got, dtype=np.int32))


def _read(name: str, buckets: int):
    """Tokens and features of each text, in one pass over it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = _counter(name), {}
        for batch in batches:
            yield batch.drop(columns="text").assign(feats=[_features(t, seen, buckets) for t in batch["text"]], tokens=np.array([count(t) for t in batch["text"]], dtype=np.int64))

    return run


def _class_counts(buckets: int, classes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((buckets, classes))
        for batch in batches:
            for label, feats in zip(batch["label"], batch["feats"], strict=True):
                total[np.asarray(feats, dtype=np.int64), label] += 1
        held = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"bucket": held.astype(np.int32)} | {f"c{k}": total[held, k] for k in range(classes)})

    return run


def _memberships(shared, classes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, prior, temperature = shared.value
        for batch in batches:
            rows = []
            for label, feats in zip(batch["label"], batch["feats"], strict=True):
                if label >= 0:
                    rows.append(np.eye(classes)[int(label)])
                else:
                    score = (weights[np.asarray(feats, dtype=np.int64)].sum(0) + prior) * temperature
                    e = np.exp(score - score.max())
                    rows.append(e / e.sum())
            yield batch.drop(columns="feats").assign(member=rows)

    return run


def _temperature(weights: np.ndarray, prior: np.ndarray, feats: list, labels: np.ndarray) -> float:
    """The factor on log scores under which the known sources of a sample are likeliest."""
    scores = np.array([weights[np.asarray(f, dtype=np.int64)].sum(0) + prior for f in feats])
    best, least = 1.0, np.inf
    for t in (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05):
        z = scores * t
        z = z - z.max(1, keepdims=True)
        loss = -(z[np.arange(len(z)), labels] - np.log(np.exp(z).sum(1))).mean()
        if loss < least:
            best, least = t, loss
    return best


def _rounded(member: np.ndarray, parts: int) -> np.ndarray:
    """Memberships in whole ``parts`` that add up to ``parts`` (largest remainders)."""
    scaled = member * parts
    whole = np.floor(scaled + 1e-9)
    missing = (parts - whole.sum(1)).round().astype(int)
    order = np.argsort(-(scaled - whole), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    return (whole + (rank < missing[:, None])).astype(np.int8)


def _memberships(shared, classes: int, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, prior, temperature = shared.value
        for batch in batches:
            if not len(batch):
                continue
            member = np.zeros((len(batch), classes))
            for i, (label, feats) in enumerate(zip(batch["label"], batch["feats"], strict=True)):
                if label >= 0:
                    member[i, int(label)] = 1
                else:
                    score = (weights[np.asarray(feats, dtype=np.int64)].sum(0) + prior) * temperature
                    e = np.exp(score - score.max())
                    member[i] = e / e.sum()
            yield batch.drop(columns="feats").assign(member=[m.tobytes() for m in _rounded(member, parts)])

    return run


def memberships(documents: DataFrame, names: list[str], tokenizer: str = TOKENIZER, buckets: int = 1 << 15, sample: int = 5000, parts: int = 10) -> DataFrame:
    """(doc_id, label, tokens, member) for every document with a text: tokens, and the membership in each of ``names`` in ``parts`` of the whole, a byte each.

    label: place of the known source in ``names``, else -1. ``sample`` bounds the labelled documents that the
    driver sees to fit the classifier's temperature; counts cover all labelled documents.
    """
    spark = documents.sparkSession
    classes = len(names)
    label = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), source_key(F.col("source"))) - 1, F.lit(-1)).cast("int")
    base = documents.where("text is not null").select("doc_id", label.alias("label"), "text")
    kind = dict(base.dtypes)["doc_id"]
    table = kept(base.mapInPandas(_read(_ship_tokenizer(spark, tokenizer), buckets), f"doc_id {kind}, label int, feats array<int>, tokens bigint"), "tokens")
    columns = [f"c{k}" for k in range(classes)]
    found = table.where("label >= 0").select("label", "feats").mapInPandas(_class_counts(buckets, classes), "bucket int, " + ", ".join(f"{c} double" for c in columns))
    got = found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()  # at most ``buckets`` rows
    counts = np.zeros((buckets, classes))
    counts[got["bucket"].to_numpy(np.int64)] = got[columns].to_numpy()
    docs = np.zeros(classes)
    for row in table.where("label >= 0").groupBy("label").count().collect():
        docs[row["label"]] = row["count"]
    weights = np.log((counts + 0.1) / (docs + 0.2))
    prior = np.where(docs > 0, np.log(np.maximum(docs, 1e-9) / max(docs.sum(), 1)), -1e9)
    bound = min(1 << 30, int(sample / max(docs.sum(), 1) * (1 << 30)) + 1)  # hashes below it are about ``sample`` documents
    some = table.where((F.col("label") >= 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)).select("label", "feats").toPandas()
    temperature = _temperature(weights, np.maximum(prior, -50), some["feats"].tolist(), some["label"].to_numpy(np.int64)) if len(some) else 1.0
    shared = spark.sparkContext.broadcast((weights, prior, temperature))
    return kept(table.mapInPandas(_memberships(shared, classes, parts), f"doc_id {kind}, label int, tokens bigint, member binary"), "members")


def fitted_rates(member: np.ndarray, tokens: np.ndarray, caps: np.ndarray, goal: np.ndarray, most: int = 5000, still: float = 1e-9) -> tuple[np.ndarray, float, int]:
    """(rates, residual, steps): nonnegative rates of groups of documents, at most the expected cap, by projected gradient on the squared misses.

    ``member`` (groups, sources), ``tokens`` per group. The step is one over the largest curvature, so the misses
    never grow; it ends when they no longer shrink by ``still`` of themselves. residual: sum of misses over the sum
    of goals.
    """
    size = np.maximum(tokens.sum(), 1.0)
    a = member * (tokens / size)[:, None] * np.sqrt(len(tokens))  # rows: what a group gives to each source at rate 1
    top = member @ caps
    rate, want = np.minimum(1.0, top), goal / size * np.sqrt(len(tokens))
    # coordinates are scaled by the tokens of their group, so that groups of any size move alike
    scale = np.maximum(np.sqrt((a**2).sum(1)), 1e-12)
    b = a / scale[:, None]
    curve = max(np.linalg.norm(b.T @ b, 2), 1e-12)
    last, steps = np.inf, 0
    point, speed = rate * scale, 1.0
    ahead = point.copy()
    for steps in range(1, most + 1):  # with momentum that starts anew when the misses grow
        after = np.clip(ahead - b @ (b.T @ ahead - want) / curve, 0, top * scale)
        loss = float(((b.T @ after - want) ** 2).sum())
        if loss > last:
            ahead, speed = point.copy(), 1.0
            continue
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        ahead = after + (speed - 1) / faster * (after - point)
        done = np.isfinite(last) and last - loss <= still * last
        point, speed, last = after, faster, loss
        if done or loss < 1e-18:
            break
    rate = point / scale
    return rate, float(np.abs(member.T @ (rate * tokens) - goal).sum() / max(goal.sum(), 1e-12)), steps


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER, bins: int = 4000, parts: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(plan, report): plan (doc_id, source, tokens, repeats) of every document used; report one row per target source.

    Report: source, target_share, max_repeats, documents (used), tokens (with repeats), actual_share (by the source
    of each document, or the likeliest), soft_share (by memberships), residual (what the fit left of all goals, the
    same in every row). ``targets`` (source, target_share, max_repeats); shares needn't sum to 1. ``total_tokens``:
    size of the mix, else the largest for which every source that has documents can meet its share within its cap.
    Repeats are whole: the fraction of a rate decides by the document's hash, with an offset per likeliest source
    chosen so that the tokens of its documents come out closest to what their rates ask for.
    Defined cases: documents whose source is null or not a target count by their memberships and are listed under the
    likeliest source; null or empty texts are not used; sources without documents, or with share 0, get 0; repeated
    targets of a source count once, the one of the largest share; an empty corpus gives an empty plan and a report
    of zeros.
    """
    spark = documents.sparkSession
    said = targets.where("source is not null").select(source_key(F.col("source")).alias("source"), F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap")).alias("t"))
    wanted = said.where("source is not null").groupBy("source").agg(F.max("t").alias("t")).select("source", "t.share", "t.cap").orderBy("source").toPandas()
    names, share, caps = wanted["source"].tolist(), wanted["share"].clip(lower=0).to_numpy(float), wanted["cap"].clip(lower=0).to_numpy(float)
    classes = len(names)
    rows = memberships(documents, names, tokenizer, parts=parts, **options).where("tokens > 0")
    # one row per membership: sources apart from each other share few of the combinations of tenths
    groups = rows.groupBy("member").agg(F.sum("tokens").alias("tokens")).orderBy("member").toPandas()
    member = np.array([np.frombuffer(m, np.int8) for m in groups["member"]], dtype=float).reshape(len(groups), classes) / parts
    tokens = groups["tokens"].to_numpy(float)
    full = member.T @ tokens  # tokens per source when each document is used once
    open_ = (full > 0) & (share > 0) & (caps > 0)
    part = np.where(open_, share, 0) / max(share[open_].sum(), 1e-12)
    total = total_tokens if total_tokens is not None else float(((caps * full)[open_] / part[open_]).min()) if open_.any() else 0.0
    rates, residual, _ = fitted_rates(member, tokens, caps, part * total) if len(groups) else (np.zeros(0), 0.0, 0)
    likeliest = member.argmax(1) if len(groups) else np.zeros(0, np.int64)
    rates = np.minimum(rates, caps[likeliest])
    shared = spark.sparkContext.broadcast({bytes(m): (int(k), float(r)) for m, k, r in zip(groups["member"], likeliest, rates, strict=True)})

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [shared.value[bytes(m)] for m in batch["member"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "k": np.array([g[0] for g in got], dtype=np.int32), "tokens": batch["tokens"].to_numpy(), "rate": np.array([g[1] for g in got], dtype=float), "member": batch["member"].to_numpy()})

    chances = rows.mapInPandas(rated, f"doc_id {dict(rows.dtypes)['doc_id']}, k int, tokens bigint, rate double, member binary")
    whole, dice = F.floor("rate"), F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    slack = dice - (F.col("rate") - whole)  # a document gains one more use once its source's offset exceeds this
    cap = F.element_at(F.array(*[F.lit(float(c)) for c in caps]), F.col("k") + 1)
    may = whole < cap
    histogram = chances.groupBy("k", F.when(may, F.floor((slack + 1) * bins / 2)).alias("bin")).agg(F.sum(whole * F.col("tokens")).alias("sure"), F.sum("tokens").alias("more"), F.sum(F.col("tokens") * F.col("rate")).alias("asked")).toPandas()
    offsets = np.full(classes, -1.0)
    for k in range(classes):
        own = histogram[histogram["k"] == k]
        sure, extra = own["sure"].sum(), own.dropna(subset="bin").sort_values("bin")
        reached = sure + np.concatenate([[0], extra["more"].cumsum()]) if len(extra) else np.array([sure])
        at = int(np.abs(reached - own["asked"].sum()).argmin())
        offsets[k] = -1.0 if at == 0 else (extra["bin"].iloc[at - 1] + 1) * 2 / bins - 1
    edge = F.element_at(F.array(*[F.lit(float(o)) for o in offsets]), F.col("k") + 1)
    taken = (whole + F.when(may & (F.floor((slack + 1) * bins / 2) < F.round((edge + 1) * bins / 2)), 1).otherwise(0)).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1) if names else F.lit("")
    plan = kept(chances.select("doc_id", name.alias("source"), "tokens", taken.alias("repeats"), "member").where("repeats > 0"), "plan")
    used = plan.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    softly = plan.groupBy("member").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")).toPandas()
    soft = sum((np.frombuffer(m, np.int8) / parts * t for m, t in zip(softly["member"], softly["tokens"], strict=True)), np.zeros(classes))
    every = max(float(softly["tokens"].sum()), 1.0)
    goals = spark.createDataFrame(pd.DataFrame({"source": names, "target_share": share, "max_repeats": caps.astype(int), "soft_share": (soft / every).round(6), "residual": round(residual, 6)}), "source string, target_share double, max_repeats int, soft_share double, residual double")
    report = goals.join(used, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.lit(every), 6), F.lit(0.0)).alias("actual_share"), "soft_share", "residual")
    return plan.drop("member"), report
