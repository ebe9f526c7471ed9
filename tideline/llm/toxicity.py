"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: words, their beginnings of STEMS bytes, pairs of neighbours, and pairs with one word between, hashed to 2^20 coordinates;
each counts once a text. Training is one task's online pass over at most ``sample`` labelled texts (those with the smallest
id hash; ``epochs`` passes), with a learning rate for each coordinate and L1 sparsity; the few weights that are not zero are
broadcast (at most 2^20 floats). Scoring covers every row.

Null text counts as empty; its score is the intercept's. Null labels teach nothing, a text with several labels is
toxic if one says so. Unless texts of both labels are found nothing is learned: every score is then just below 0.5, and
nothing is predicted toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import smallest_hashes, word_bytes

BITS = 20
SAMPLE = 20_000
STEMS = (4, 7)


def spread(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h ^ np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    """Different coordinates of a text, sorted."""
    words = word_bytes(text)
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    stems = [spread(np.fromiter((crc32(w[:n]) for w in words if len(w) > n), np.uint32), 4 + k) for k, n in enumerate(STEMS)]
    pair, skip = h[:-1] * np.uint32(31) + h[1:], h[:-2] * np.uint32(37) + h[2:]
    return np.unique(np.concatenate((spread(h, 1), spread(pair, 2), spread(skip, 3), *stems))).astype(np.int32)


class Ftrl:
    """w is zero while |z| is at most l1; else (sign(z) l1 - z) / ((beta + sqrt(n)) / alpha + l2)."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == 1 << BITS, 0.0, self.l1)  # the intercept is free
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2), 0.0)

    def learn(self, i: np.ndarray, y: float) -> float:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        root = np.sqrt(self.n[i])
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - root) / self.alpha * w
        self.n[i] += g * g
        return p


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, sample: int = SAMPLE, epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights (coordinate 2^20: intercept). ``where``: which label rows may teach."""
    known = labels.where(where) if where is not None else labels
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    few = smallest_hashes(known, sample, known.count(), "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    one = rows.select("text", "y", "h", "id").repartition(1).sortWithinPartitions("h", "id", "text")
    schema = pa.schema([("i", pa.int32()), ("w", pa.float64())])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(alpha, beta, l1, l2)
        seen: list[tuple[np.ndarray, float]] = []
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.append((np.append(features(t), np.int32(1 << BITS)), float(y)))
                model.learn(*seen[-1])
        for _ in range(epochs - 1 if seen else 0):
            for i, y in seen:
                model.learn(i, y)
        if len({y for _, y in seen}) == 2:
            w = model.weights(np.arange((1 << BITS) + 1))
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w[i])], schema=schema)

    got = one.mapInArrow(train, "i int, w double").toPandas()
    if not len(got):
        return np.array([1 << BITS], np.int32), np.array([-1e-9])
    return got["i"].to_numpy(np.int32), got["w"].to_numpy(np.float64)


def score(docs: DataFrame, text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Probability (double) that a text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros((1 << BITS) + 1)
        w[sent.value[0]] = sent.value[1]
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(w[features(t)].sum() + w[-1], -35, 35))) for t in texts], dtype="float64")

    return probability(text)
