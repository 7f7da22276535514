"""Where outside models would be called: interfaces, and deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from memlode.operators import texts


class Embedder(Protocol):
    """Texts to vectors of one length, a batch at a time."""

    dimensions: int

    def embed(self, batch: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed places, normalised: equal texts get equal vectors, and texts that share words are close."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), self.dimensions), np.float32)
        for row, text in enumerate(batch):
            for word in text.lower().split():
                digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, digest % self.dimensions] += 1 if digest >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norms > 0, out / np.maximum(norms, 1e-12), 0)


def embedding(text: Column, embedder: Embedder) -> Column:
    """Vectors by an Arrow-batched function; null texts stay null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batch: pd.Series) -> pd.Series:
        known = [t if isinstance(t, str) else None for t in batch]
        made = iter(embedder.embed([t for t in known if t is not None]))
        return pd.Series([None if t is None else next(made) for t in known], dtype=object)

    return run(text)


class Extractor(Protocol):
    """Messages to candidate memories (id, content, memory_type, importance, confidence)."""

    def extract(self, messages: DataFrame) -> DataFrame: ...


class RuleExtractor:
    """Keeps messages that are worth remembering, as they are; importance is their significance."""

    def __init__(self, least: float = 0.3):
        self.least = least

    def extract(self, messages: DataFrame) -> DataFrame:
        scored = messages.where(F.col("content").isNotNull()).withColumn("importance", texts.significance(F.col("content")))
        return scored.where(F.col("importance") >= self.least).select("id", "content", F.lit("CONTEXT").alias("memory_type"), "importance", F.lit(0.9).alias("confidence"))
