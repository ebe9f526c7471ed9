"""Near copies by the exact Jaccard similarity of word shingle sets: components of the pairs at ``LEAST`` or more.

Fingerprints and BK-trees (see ``simhash``) only choose what is compared. Two sets at similarity s share at least s of the
larger, so in any fixed order of all shingles they share one of their first n - ceil(s n) + 1: these prefix shingles are the
buckets, and no pair at ``LEAST`` fails to meet. The order puts shingles that a sample of texts shows to be frequent last
and goes by hash else; which ones these are changes the work and no result. In a bucket BK-trees link fingerprints within a radius far
beyond the limit; star joins make candidate groups of the links.

A group is compared in full by exact similarity, in blocks if it is large, and only pairs at ``LEAST`` become links. Sets that
are equal collapse to one row before. Shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import simhash
from tideline.llm.common import ragged, scratch, space_words

#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Bits of 256 that differ are 39 at similarity 0.8, with a deviation of 6, and 48 if the sets have 4 and 5 shingles.
WORDS64, RADIUS = 4, 80
#: Texts of the sample, its texts that make a shingle frequent, and how many of these are sent.
SAMPLE, OFTEN, FREQUENT = 2_000, 4, 200_000
#: Shingles of a block of a group.
BLOCK = 1_000_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(space_words(text), size))


def prefix(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set of which one at least is shared with any set at ``LEAST``."""
    up, down = LEAST
    n = len(h) - -(-up * len(h) // down) + 1 if len(h) else 0
    late = np.isin(h, frequent)
    return np.concatenate((h[~late], h[late]))[:n]


def frequent_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that are in ``OFTEN`` or more different texts of a sample. ``texts``: one column."""
    text = F.col(texts.columns[0])
    share = min(1.0, SAMPLE / max(1, texts.count()))

    @F.pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([shingle_set(t, size).view(np.int64) for t in some], dtype=object)

    few = texts.where(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) <= F.lit(int(share * ((1 << 62) - 1)))).distinct()
    counts = few.select(F.explode(sets(text)).alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    found = [r.h for r in counts.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def described(text: Column, size: int, frequent: np.ndarray) -> Column:
    """sid (digest of the set), fp, keys (prefix shingles) of each text."""

    @F.pandas_udf("sid binary, fp binary, keys array<bigint>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_set(t, size)
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), simhash.fingerprint_of(h, WORDS64), prefix(h, frequent).view(np.int64)))
            yield pd.DataFrame(rows, columns=["sid", "fp", "keys"])

    return describe(text)


def shared_keys(keys: DataFrame) -> DataFrame:
    """key, node -> the rows of keys with two nodes or more, each once."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, v = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(end: bool) -> pa.RecordBatch:
            nonlocal k, v
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            k, v = k[new], v[new]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            last = np.append(first[1:], True)[: len(k)]
            keep = ~(first & last)
            done = len(k) if end else int(np.flatnonzero(first)[-1])  # the last key may go on in the next batch
            out = pa.RecordBatch.from_arrays([pa.array(k[:done][keep[:done]]), pa.array(v[:done][keep[:done]])], schema=schema)
            k, v = k[done:], v[done:]
            return out

        for batch in batches:
            if batch.num_rows:
                k, v = np.append(k, batch.column(0).to_numpy()), np.append(v, batch.column(1).to_numpy())
                yield rows(False)
        yield rows(True)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(met, "key bigint, node bigint")


def candidates(different: DataFrame) -> DataFrame:
    """sid, row, root: the sets of candidate groups of two or more. ``different``: sid, row, fp, keys."""
    node = F.xxhash64("fp").alias("node")
    shared = shared_keys(different.select(F.explode("keys").alias("key"), node))
    prints = different.select("fp", node).distinct()
    buckets = scratch(shared.join(prints, "node").select(F.lit(0).alias("t"), "key", "fp"))
    found = simhash.components(simhash.bucket_links(buckets, RADIUS))
    named = different.join(found, different.fp == found.node, "left").select("sid", "row", F.coalesce("root", "fp").alias("root"))
    several = named.groupBy("root").count().where("count > 1").select("root")
    return named.join(several, "root")


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """Label of each set: the smallest index of its component by pairs at ``LEAST``."""
    up, down = LEAST
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    postings, counts = owner[order], np.bincount(shingle)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    label = np.arange(n)
    asked = np.zeros(n, bool)
    for i in range(n):
        if asked[i]:
            continue
        mine = shingle[ends[i] - sizes[i] : ends[i]]
        both = np.bincount(postings[ragged(starts[mine], counts[mine])[1]], minlength=n)
        near = np.flatnonzero(down * both >= up * (sizes + sizes[i] - both))
        if label[i] == i and not asked[:i].any():
            asked[near] = True  # pairs among the first set's partners are linked through it; all others are asked for
        label = simhash.merge_labels(label, np.full(len(near), i), near)
    return label


def exact_links(sets: DataFrame) -> DataFrame:
    """a, b: from each set to the first of its component in its group or pair of blocks. ``sets``: root, sid, h, n."""
    sizes = sets.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        sets.join(sizes, "root")
        .withColumn("s", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks <= 1 OR s <> o")
        .select("root", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), "sid", "h")
    )
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, held = None, [], []

        def flush() -> pa.RecordBatch:
            label = alike(held).tolist() if len(held) > 1 else [0] * len(held)
            rows = [(ids[i], ids[k]) for i, k in enumerate(label) if i != k]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

        for batch in batches:
            for root, a, b, sid, h in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, a, b) != last:
                    if len(held) > 1:
                        yield flush()
                    last, ids, held = (root, a, b), [], []
                ids.append(sid)
                held.append(np.frombuffer(h, np.uint64))
        yield flush()

    return dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(link, "a binary, b binary")


def verified(docs: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, component (the same for all near copies) of every row. ``id_col``: different integers."""
    text, row = F.col(text_col), F.col(id_col)
    frequent = frequent_shingles(docs.select(text_col), size)
    tagged = scratch(docs.select(row.alias("row"), described(text, size, frequent).alias("d")).select("row", "d.*"))
    different = scratch(tagged.groupBy("sid").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    chosen = scratch(candidates(different))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, size).tobytes() for t in texts], dtype=object)

    sets = docs.select(row.alias("row"), text.alias("text")).join(chosen, "row").select("root", "sid", packed("text").alias("h"))
    sets = scratch(sets.withColumn("n", F.length("h") / 8))
    found = simhash.components(exact_links(sets))
    return tagged.join(found, tagged.sid == found.node, "left").select(F.col("row").alias("id"), F.coalesce("root", "sid").alias("component"))
