"""Language ID by rank-order profiles.

A profile is the ``top`` most frequent letter n-grams (1 to 3 letters; a word's edge counts as a letter) of all training
texts of a language, most frequent first. A text is compared by out-of-place distance: for each of its own ``top``
n-grams the difference between the two ranks, or ``top`` where the profile lacks it. The nearest language wins, ties to
the smaller name; the score is 1 - distance / largest possible distance.

N-grams are exact (21 bits a letter), ties in frequency go to the smaller code. Counts are summed in the tasks, then by
Spark; only profiles (``top`` rows a language) reach the driver, and more than ``max_languages`` raise an error.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be learned.
Rows with a null language or no letters teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
PIECE = 1 << 20
UND = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def coded(text: str | None) -> np.ndarray:
    """Lower-case letters as code points, every run of others as one 0, and a 0 at both ends."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[raw], raw, 0).astype(np.int64)
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]


def gram_counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a coded text (sorted codes) and how often each stands in it."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(1, len(c) - 1, PIECE):  # long texts in pieces; neighbours of a piece's letters are at hand
        b = min(a + PIECE, len(c) - 1)
        mid, left, right = c[a:b], c[a - 1 : b - 1], c[a + 1 : b + 1]
        real = mid != 0
        pairs = (mid << 21) | right
        first = (left == 0) & real
        grams = np.concatenate((mid[real], pairs[real] | 1 << 62, mid[first] | 1 << 62, ((left << 42) | pairs)[real] | 3 << 61))
        some, n = np.unique(grams, return_counts=True)
        found, counts = (some, n) if not len(found) else summed(np.concatenate((found, some)), np.concatenate((counts, n)))
    return found, counts


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, at = np.unique(codes, return_inverse=True)
    return some, np.bincount(at, counts, len(some)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:top]]


def count_grams(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """lang, gram, n over all rows with a language."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(counts)], schema=schema)
            held.clear()

        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(coded(t))
            for name, texts in by_lang.items():
                codes, counts = gram_counts(np.concatenate(texts))
                if name in held:
                    codes, counts = summed(np.concatenate((held[name][0], codes)), np.concatenate((held[name][1], counts)))
                held[name] = codes, counts
            if sum(len(c) for c, _ in held.values()) > PIECE:
                yield from rows()
        yield from rows()

    taught = docs.select(text.alias("text"), lang.alias("lang")).where("text is not null and lang is not null")
    return taught.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: Column, lang: Column, *, top: int = TOP, max_languages: int = 1000) -> dict[str, list[int]]:
    """Profiles: n-gram codes of each language, most frequent first."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = count_grams(docs, text, lang).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    rows = best.select("lang", "gram", "r").limit(max_languages * top + 1).collect()
    if len(rows) > max_languages * top:
        raise ValueError(f"more than {max_languages} languages")
    profiles: dict[str, list[int]] = {}
    for name, gram, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        profiles.setdefault(name, []).append(gram)
    return profiles


def predict(docs: DataFrame, text: Column, profiles: dict[str, list[int]], *, top: int = TOP) -> Column:
    """struct<lang, score> of a text."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = sorted(sent.value)
        known = np.unique(np.array([g for p in sent.value.values() for g in p], np.int64))
        places = np.full((len(known) + 1, len(names)), -1, np.int64)  # the last row: in no profile
        for k, name in enumerate(names):
            places[np.searchsorted(known, sent.value[name]), k] = np.arange(len(sent.value[name]))
        for texts in batches:
            out = []
            for t in texts:
                codes, counts = gram_counts(coded(t))
                if not len(codes) or not names:
                    out.append((UND, 0.0))
                    continue
                own = ranked(codes, counts, top)
                at = np.searchsorted(known, own)
                at[at < len(known)] = np.where(known[at[at < len(known)]] == own[at < len(known)], at[at < len(known)], len(known))
                place = places[at]
                d = np.where(place < 0, top, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
                k = int(d.argmin())
                out.append((names[k], float(1 - d[k] / (top * len(own)))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return nearest(text)
