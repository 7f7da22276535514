"""Subject areas of documents: complement naive Bayes over sentences, expectation-maximisation, calibrated posteriors.

Documents become numbers once, in one pass over their text: hashed words and word pairs of each sentence. A model is a table of ``buckets`` by
subjects (plus 'none') and languages, of fixed size whatever the corpus; each pass adds up expected counts over
all documents, combined per task and then per bucket. Sentences of labelled documents are held to their labels,
all others take part with their posteriors. Per subject, the share of a document's sentences is then calibrated
into a posterior of its own, so a document may have several subjects or none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.canonical import folded_text
from memlode.runtime import kept

NONE = "none"


_LINES, _ENDS, _LETTERS = re.compile(r"[\n\r\x85\u2028\u2029]+"), re.compile(r"(?<=[.!?…])\s+"), re.compile(r"[^\W\d_]+")
_HEADING, _LABEL = re.compile(r"\s*(?:#|$)"), re.compile(r"\s*(?:[-*•]\s+|[^\W\d_]+:\s+)")


def sentences(text: str, longest: int = 40, piece: int = 12) -> list[list[str]]:
    """Word lists of the sentences of a text (folded already), whole texts in.

    Lines are split after full stops, question and exclamation marks; heading lines, bullets and speaker names are
    left out. A stretch of more than ``longest`` words without any such mark (transcripts) is cut into pieces of
    ``piece`` words.
    """
    out = []
    for line in _LINES.split(text):
        if _HEADING.match(line):
            continue
        label = _LABEL.match(line)
        for part in _ENDS.split(line[label.end() :] if label else line):
            said = _LETTERS.findall(part)
            if len(said) > longest:
                out += [said[i : i + piece] for i in range(0, len(said), piece)]
            elif said:
                out.append(said)
    return out


def _features(buckets: int):
    """Hashed words and word pairs of each sentence, each once, sentences ended by -1: one flat integer array per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        seen: dict[str, int] = {}
        for batch in batches:
            made = []
            for text in batch["text"]:
                found = sentences(folded_text(text))
                if len(seen) > 500_000:
                    seen.clear()
                flat = [seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w)) for s in found for w in s]
                word = np.array(flat, dtype=np.uint64)
                row = np.repeat(np.arange(len(found)), [len(s) for s in found])
                together = row[1:] == row[:-1]
                pair = ((word[:-1] * _MIX_A) ^ (word[1:] * _MIX_B))[together]
                pair ^= pair >> np.uint64(29)
                number = np.concatenate([word, pair]) % np.uint64(buckets)
                key = np.unique(np.concatenate([row, row[:-1][together]]) * (buckets + 1) + number.astype(np.int64))
                ends = np.arange(1, len(found) + 1) * (buckets + 1) - 1  # after all features of its sentence
                key = np.sort(np.concatenate([key, ends]))
                number = (key % (buckets + 1)).astype(np.int32)
                number[number == buckets] = -1
                made.append(number)
            yield batch.drop(columns="text").assign(feats=made)

    return run


_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers, any would do


@dataclass
class Model:
    """``weights`` (buckets, classes): how rare a feature is in the complement of a class, as a negative logarithm; ``language`` (buckets, languages): log frequencies; ``prior`` of the classes."""

    weights: np.ndarray | None
    language: np.ndarray
    prior: np.ndarray | None


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, sentence of each feature, document of each sentence."""
    lists = [np.asarray(x, dtype=np.int32) for x in batch["feats"]]
    joined = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    ends = joined < 0
    doc = np.repeat(np.arange(len(lists)), [int((x < 0).sum()) for x in lists])
    return joined[~ends].astype(np.int64), (np.cumsum(ends) - ends)[~ends], doc


def _by_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` that belong to each of ``rows`` groups in ascending order."""
    out = np.zeros((rows, values.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else e


def posteriors(model: Model, feats: np.ndarray, sentence: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, float]:
    """Class posteriors of each sentence, and the logarithm of how likely the sentences are; a document's sentences share a mixture that is fitted with them."""
    scores = _by_row(model.weights[feats], sentence, len(doc))
    out = _softmax(scores + np.log(model.prior))
    for _ in range(3):
        mix = _by_row(out, doc, docs) + model.prior
        joint = scores + np.log(mix / mix.sum(1, keepdims=True))[doc]
        out = _softmax(joint)
    top = joint.max(axis=1, initial=-np.inf)
    return out, float((top + np.log(np.exp(joint - top[:, None]).sum(1))).sum()) if len(joint) else 0.0


def _languages(model: Model, feats: np.ndarray, sentence: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The likeliest language of each document."""
    return _by_row(_by_row(model.language[feats], sentence, len(doc)), doc, docs).argmax(1)


def _label_matrix(batch: pd.DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    known = np.array([x is not None for x in batch["labels"]], dtype=bool)
    share = np.zeros((len(batch), classes))
    for i in np.flatnonzero(known):
        share[i] = batch["labels"].iloc[i]
    return known, share


def _counted(buckets: int, feats: np.ndarray, rows: np.ndarray, columns: np.ndarray | None, weight: np.ndarray, width: int) -> np.ndarray:
    if columns is not None:  # one column per row, weight a vector
        return np.bincount(feats * width + columns[rows], weight[rows], minlength=buckets * width).reshape(buckets, width)
    return np.stack([np.bincount(feats, weight[rows, k], minlength=buckets) for k in range(width)], axis=1)


def _emitted(total: np.ndarray) -> pd.DataFrame:
    held = np.flatnonzero(total.any(axis=1))
    return pd.DataFrame({"bucket": held.astype(np.int32)} | {f"c{k}": total[held, k] for k in range(total.shape[1])})


def _language_counts(buckets: int, languages: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((buckets, languages))
        for batch in batches:
            feats, sentence, doc = _flat(batch)
            said = batch["language"].to_numpy(np.int64)[doc]
            known = said[sentence] >= 0
            total += _counted(buckets, feats[known], sentence[known], said, np.ones(len(doc)), languages)
        yield _emitted(total)

    return run


def _expected_counts(shared, buckets: int, classes: int, languages: int, first: bool):
    """Expected (bucket, class) counts of a task's sentences; rows from ``buckets`` on count sentences per language, the last holds the log likelihood and the sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        total = np.zeros((buckets + languages + 1, classes))
        for batch in batches:
            feats, sentence, doc = _flat(batch)
            if not len(doc):
                continue
            known, share = _label_matrix(batch, classes)
            if first:
                held = share[doc].copy()
                held[:, -1] = np.maximum(held[:, -1], 0.5)  # any document has sentences on nothing in particular
            else:
                bound = np.ones((len(batch), classes))
                bound[known] = np.maximum(0.02, share[known])
                bound[:, -1] = 1
                held, likely = posteriors(model, feats, sentence, doc, len(batch))
                held = held * bound[doc]
                total[-1, 0] += likely
                total[-1, 1] += len(doc)
            held /= held.sum(1, keepdims=True)
            spoken = _languages(model, feats, sentence, doc, len(batch))[doc]
            total[:buckets] += _counted(buckets, feats, sentence, None, held, classes)
            np.add.at(total, buckets + spoken, held)
        yield _emitted(total)

    return run


def _summed(df: DataFrame, mapper, width: int, rows: int) -> np.ndarray:
    """Adds up what the tasks emit; at most ``rows`` rows reach the driver."""
    columns = [f"c{k}" for k in range(width)]
    parts = df.mapInPandas(mapper, "bucket int, " + ", ".join(f"{c} double" for c in columns))
    got = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    out = np.zeros((rows, width))
    out[got["bucket"].to_numpy(np.int64)] = got[columns].to_numpy()
    return out


def _maximised(counts: np.ndarray, buckets: int, language: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Complement weights from expected counts, within the language in which a feature is most at home, shrunk towards that language's average."""
    words, spoken = counts[:buckets], counts[buckets:]
    home = language.argmax(1)
    total, own, every = words.sum(1, keepdims=True), spoken[home], spoken.sum(1)[home][:, None]
    average = (total + 0.5) / (every + 1)
    weights = -np.log((total - words + strength * average) / (every - own + strength))
    weights -= weights.mean(1, keepdims=True)  # the same for all classes, so without influence; keeps rare features small
    weights[total[:, 0] <= 0] = 0
    prior = spoken.sum(0) + 1
    return weights.astype(np.float32), prior / prior.sum()


def _shares(shared, subjects: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            feats, sentence, doc = _flat(batch)
            hard = np.zeros((len(doc), subjects + 1))
            if len(doc):
                hard[np.arange(len(doc)), posteriors(shared.value, feats, sentence, doc, len(batch))[0].argmax(1)] = 1
            share = _by_row(hard, doc, len(batch)) / np.maximum(np.bincount(doc, minlength=len(batch)), 1)[:, None]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "share": list(share[:, :subjects]), "labels": batch["labels"].to_numpy()})

    return run


def _calibrated(share: np.ndarray, said: np.ndarray, threshold: float, steps: int = 50) -> tuple[float, np.ndarray]:
    """Logistic posteriors P(subject) = s(slope (share - threshold) + offset_k), offsets shrunk to 0; Newton steps."""
    k = share.shape[1]
    x = (share - threshold) * 10
    design = np.concatenate([x.reshape(-1, 1), np.tile(np.eye(k), (len(x), 1))], axis=1)
    y, beta, ridge = said.reshape(-1), np.zeros(k + 1), np.concatenate([[1e-3], np.full(k, 5.0)])
    beta[0] = 3.0
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.5)), beta[1:]


def subject_posteriors(documents: DataFrame, labels: DataFrame, names: Sequence[str], rounds: int = 6, gain: float = 0.01, buckets: int = 1 << 17, strength: float = 50.0, threshold: float = 0.25, least_language: float = 0.001, calibration_rows: int = 50_000) -> DataFrame:
    """(doc_id, subject, share, posterior) for every document and subject that any sentence was taken to deal with.

    share: part of the document's sentences; posterior: calibrated probability that it is ``threshold`` or more.
    ``labels`` (doc_id, subject) may be wrong, repeated or written in other case; unknown subjects are left out,
    'none' is one. Annotators who disagree count by their share. Maximisation ends when the mean log likelihood of a
    sentence gains less than ``gain``, at the latest after ``rounds``. Languages are told apart by what stands in
    ``lang`` before a hyphen or underscore; spellings that less than ``least_language`` of the documents have are
    treated as unknown, and such documents join the language their words fit best. ``calibration_rows`` bounds the
    labelled documents whose shares the driver sees; counts cover all documents. Defined cases: null or empty texts,
    and texts without letters, get no row; repeated documents of an id are each judged and give equal rows once;
    without any label nothing can be learnt and no row comes out; other columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted(set(names) - {NONE})
    classes = len(names) + 1
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("s"), F.col("annotator") if "annotator" in labels.columns else F.lit("").alias("annotator"))
    said = clean.where(F.col("doc_id").isNotNull() & F.col("s").isin([*names, NONE])).distinct().groupBy("doc_id")
    heads = F.greatest(F.countDistinct("annotator"), F.lit(1))
    shares = said.agg(F.array(*[F.count(F.when(F.col("s") == n, 1)) / heads for n in [*names, NONE]]).alias("labels"))
    tongue = F.nullif(F.regexp_replace(F.lower(F.trim("lang")), r"[-_].*$", ""), F.lit(""))
    base = documents.where("doc_id is not null and text is not null").select("doc_id", "text", tongue.alias("tongue"))
    spoken = base.groupBy("tongue").agg(F.count("*").alias("n"))
    enough = spoken.join(F.broadcast(spoken.agg((F.sum("n") * least_language).alias("least")))).where("tongue is not null and n >= least")
    tongues = sorted(r[0] for r in enough.select("tongue").collect()) or [""]  # at most 1 / least_language
    number = F.array_position(F.array(*[F.lit(t) for t in tongues]), F.col("tongue")) - 1
    kind = dict(base.dtypes)["doc_id"]
    made = base.join(shares, "doc_id", "left").select("doc_id", "labels", F.coalesce(number, F.lit(-1)).cast("int").alias("language"), "text")
    made = made.mapInPandas(_features(buckets), f"doc_id {kind}, labels array<double>, language int, feats array<int>")
    table = kept(made.where(F.size("feats") > 0), "features")
    language = _summed(table.select("language", "feats"), _language_counts(buckets, len(tongues)), len(tongues), buckets)
    language = np.log((language + 0.01) / (language.sum(0) + 1)).astype(np.float32)
    model, last = Model(None, language, None), -np.inf
    for step in range(rounds + 1):
        source = table.where("labels is not null") if step == 0 else table
        shared = spark.sparkContext.broadcast(model)
        counts = _summed(source.select("labels", "feats"), _expected_counts(shared, buckets, classes, len(tongues), step == 0), classes, buckets + len(tongues) + 1)
        if not counts.any():
            return spark.createDataFrame([], f"doc_id {kind}, subject string, share double, posterior double")
        likely = counts[-1, 0] / max(counts[-1, 1], 1)
        weights, prior = _maximised(counts[:-1], buckets, language, strength)
        model = Model(weights, language, prior)
        if step > 0 and likely - last < gain:
            break
        last = likely if step > 0 else -np.inf
    shared = spark.sparkContext.broadcast(model)
    judged = kept(table.select("doc_id", "labels", "feats").mapInPandas(_shares(shared, len(names)), f"doc_id {kind}, share array<double>, labels array<double>"), "judged")
    labelled = judged.where("labels is not null")
    bound = min(1 << 30, int(calibration_rows / max(labelled.count(), 1) * (1 << 30)) + 1)  # hashes below it are about ``calibration_rows`` documents
    known = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound).toPandas()
    matrix = lambda column: np.array([np.asarray(v)[: len(names)] for v in column]).reshape(len(known), len(names))
    slope, offsets = _calibrated(matrix(known["share"]), matrix(known["labels"]), threshold)
    rows = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("subject"), F.col("share").alias("share"), F.array(*[F.lit(float(o)) for o in offsets]).alias("offset"))
    flat = judged.select("doc_id", F.inline(rows)).where("share > 0")
    chance = 1 / (1 + F.exp(-(F.lit(slope * 10) * (F.col("share") - threshold) + F.col("offset"))))
    return flat.select("doc_id", "subject", "share", chance.alias("posterior")).distinct()


def subjects_of(documents: DataFrame, labels: DataFrame, names: Sequence[str], least: float = 0.5, **options) -> DataFrame:
    """(doc_id, subject): subjects whose calibrated posterior is ``least`` or more."""
    return subject_posteriors(documents, labels, names, **options).where(F.col("posterior") >= least).select("doc_id", "subject")
