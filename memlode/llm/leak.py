"""Evaluation passages inside training text, found with an FM-index per shard of documents.

Each task turns the whole texts of its documents into word numbers of its own, sorts their suffixes, keeps the
Burrows-Wheeler transform in a wavelet matrix and looks all phrases up by backward search; sampled suffix positions
give the places, which are merged into spans to remove. Documents are never shuffled: only hits are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.llm.canonical import composed, folded, words, words_of
from memlode.runtime import kept


@dataclass
class WaveletMatrix:
    """Rank and access over symbols of ``bits`` bits; ``ones[level][i]`` counts the set bits before place i."""

    bits: int
    ones: list[np.ndarray]
    zeros: list[int]

    @classmethod
    def of(cls, symbols: np.ndarray, sigma: int) -> WaveletMatrix:
        bits = max(1, int(sigma - 1).bit_length())
        ones, zeros, now = [], [], symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            zeros.append(int(len(now) - ones[-1][-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        return cls(bits, ones, zeros)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbols[k]`` before ``places[k]``."""
        first, at = np.zeros(len(places), np.int64), places.astype(np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbols >> level) & 1) == 1
            a, b = self.ones[k][first], self.ones[k][at]
            first, at = np.where(one, self.zeros[k] + a, first - a), np.where(one, self.zeros[k] + b, at - b)
        return at - first

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = places.astype(np.int64), np.zeros(len(places), np.int64)
        for k in range(self.bits):
            before = self.ones[k][at]
            one = self.ones[k][at + 1] - before
            out = out * 2 + one
            at = np.where(one == 1, self.zeros[k] + before, at - before)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes (prefix doubling). No suffix may be a prefix of another.

    A rank is the place in the order where the group of suffixes that aren't told apart yet begins; each round sorts
    only what is in groups of several.
    """
    n = len(text)
    _, rank, counts = np.unique(text, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[rank].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    slots = np.flatnonzero(counts[np.searchsorted(np.cumsum(counts), np.arange(n), side="right")] > 1)
    while len(slots):
        at = order[slots]
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[slots] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
        slots = slots[~(first & np.concatenate([first[1:], [True]]))]
        step *= 2
    return order


class FMIndex:
    """Word-level index of several texts. Symbol 0 ends a text; ``sample``: every how many words a place is kept."""

    def __init__(self, texts: list[np.ndarray], sigma: int, sample: int = 8):
        self.starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1].astype(np.int64)
        joined = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
        ends = np.flatnonzero(joined == 0)
        ordered = joined + len(ends)  # ends get numbers of their own below all words, so suffixes stop there
        ordered[ends] = np.arange(len(ends))
        order = suffix_order(ordered)
        before = joined[order - 1]
        self.wavelet = WaveletMatrix.of(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=sigma))]).astype(np.int64)
        opening = np.zeros(len(joined), bool)
        opening[self.starts] = True
        self.sampled = opening[order] | (order % sample == 0)
        self.samples = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``patterns`` (all of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.sampled), np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, column]
            a = self.first[symbols] + self.wavelet.rank(symbols, low[alive])
            b = self.first[symbols] + self.wavelet.rank(symbols, high[alive])
            low[alive], high[alive] = a, np.maximum(a, b)
            alive = alive[a < b]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the joined text of suffix numbers, by steps back to the nearest sampled place."""
        at, steps, out = rows.astype(np.int64).copy(), 0, np.full(len(rows), -1, np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            known = self.sampled[at[open_rows]]
            done = open_rows[known]
            out[done] = self.places[self.samples[at[done]]] + steps
            open_rows = open_rows[~known]
            symbols = self.wavelet.access(at[open_rows])
            at[open_rows] = self.first[symbols] + self.wavelet.rank(symbols, at[open_rows])
            steps += 1
        return out


def _shards(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple[list, list[np.ndarray], dict[str, int]]]:
    """Ids, word numbers and vocabulary of about ``limit`` words at a time; a text is never divided. Numbers start at 1."""
    ids, texts, numbers, held = [], [], {}, 0
    for batch in batches:
        for key, text in zip(batch["_id"], batch["_text"], strict=True):
            found = words_of(text)
            ids.append(key)
            texts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in found], dtype=np.int64))
            held += len(found) + 1
            if held >= limit:
                yield ids, texts, numbers
                ids, texts, numbers, held = [], [], {}, 0
    if ids:
        yield ids, texts, numbers


def _patterns(passages: list[tuple[int, list[str], list[int]]], numbers: dict[str, int], run: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of ``passages`` (item, words, starts of its own phrases) of which the shard has every word, and their items."""
    rows, owners = [np.zeros((0, run), np.int64)], [np.zeros(0, np.int64)]
    for item, said, starts in passages:
        known = np.array([numbers.get(w, -1) for w in said], dtype=np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(known, run)[starts]
        windows = windows[(windows > 0).all(axis=1)]
        rows.append(windows)
        owners.append(np.full(len(windows), item, dtype=np.int64))
    return np.concatenate(rows), np.concatenate(owners)


def _scan(passes: list, run: int, limit: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts, numbers in _shards(batches, limit):
            index = FMIndex(texts, len(numbers) + 1)
            for shared in passes:
                patterns, owners = _patterns(shared.value, numbers, run)
                low, high = index.search(patterns)
                counts = high - low
                hit = np.repeat(np.arange(len(patterns)), counts)
                rows = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts) + low[hit]
                place = index.locate(rows)
                doc = np.searchsorted(index.starts, place, side="right") - 1
                found = pd.DataFrame({"doc": doc, "_item": owners[hit], "start_word": place - index.starts[doc] if len(doc) else doc})
                found = found.sort_values(["doc", "_item", "start_word"]).drop_duplicates()
                # runs that overlap or touch within a text and item become one span
                apart = (found["start_word"] > found.groupby(["doc", "_item"])["start_word"].shift(fill_value=-(10**9)) + run).cumsum()
                spans = found.groupby(["doc", "_item", apart.rename("_span")], as_index=False)["start_word"].agg(["min", "max"])
                yield pd.DataFrame({"_id": pd.Series([ids[i] for i in spans["doc"]], dtype=object), "_item": spans["_item"].astype(np.int64), "start_word": spans["min"].astype(np.int64), "end_word": (spans["max"] + run).astype(np.int64)})

    return scan


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, shard_words: int = 300_000, phrases_per_pass: int = 500_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, end_word): merged spans of documents that hold ``run`` consecutive words of an item.

    A run counts only if it occurs in the passage of no other item. Words are maximal runs of letters and digits,
    composed and without case; places count words from 0, the end is exclusive. Every text is searched whole and
    by every phrase. ``items`` (item_id, passage) is the small side: the words of its passages are broadcast, in
    parts of about ``phrases_per_pass`` phrases; all phrases of an item are in one part and every part is searched
    in the one index of a shard, so the parts have no influence on the result.
    Defined cases: null texts or passages, passages shorter than ``run`` words and empty tables find nothing;
    repeated documents or items are found once per id; other columns are ignored.
    """
    spark = documents.sparkSession
    passages = items.select(F.col("item_id").cast("bigint").alias("item"), words(folded(composed(F.col("passage")))).alias("w")).where((F.size("w") >= run) & F.col("item").isNotNull()).distinct()
    runs = passages.select("item", "w", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - run), lambda i: F.concat_ws(" ", F.slice("w", i + 1, run)))).alias("start", "phrase"))
    own = runs.groupBy("phrase").agg(F.min("item").alias("_first"), F.max("item").alias("_last")).where("_first = _last").select("phrase")
    starts = kept(runs.join(own, "phrase", "left_semi").groupBy("item", "w").agg(F.collect_list("start").alias("starts")), "phrases")  # at most one entry per word of a passage
    total = starts.agg(F.sum(F.size("starts"))).first()[0] or 0
    parts = max(1, -(-total // phrases_per_pass))
    passes = []
    for k in range(parts):
        some = starts.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).orderBy("item").collect()
        passes.append(spark.sparkContext.broadcast([(r["item"], r["w"], sorted(r["starts"])) for r in some]))
    texts = documents.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    found = texts.mapInPandas(_scan(passes, run, shard_words), f"_id {dict(texts.dtypes)['_id']}, _item bigint, start_word bigint, end_word bigint")
    return found.distinct().select(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"), "start_word", "end_word")
