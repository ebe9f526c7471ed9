"""SimHash near-duplicates: fingerprints, BK-tree links and components.

Fingerprint: word shingles hashed by XXH64 (seed 42); a bit is set if it is set in over half the hashes. Fewer words
than a shingle: the whole sequence is the one shingle. No words: zero. ``words64`` over 1 extends the hashes by mixing.

Links: fingerprints at ``radius`` or fewer differing bits. Copies collapse to one row first. Fingerprints are dealt to
buckets by key bits. With ``tables=None`` the bits are cut to ``blocks`` blocks and every choice of blocks - radius of them
is a key, so each pair within the radius meets in a bucket (pigeonhole): no link is lost. With ``tables`` given, that
many seeded random choices of ``key_bits`` bits are keys instead, for radii that blocks can't serve; a pair at h of
n bits is then missed with probability (1 - ((n-h)/n)^key_bits)^tables, about.

Every bucket is a BK-tree: children are keyed by integer Hamming distance to their parent, and a search follows only
edges within the radius. The trees of many buckets are grown and searched together, level by level, as one forest.
A bucket over ``SHARD`` rows is split to shards; each pair of shards is a group of its own (one's rows search
the other's tree), so no bucket has to fit in a task. A group gives links to one member of each local component, not all
pairs; alternating star joins then connect the components.

Null text counts as no words. Null ids keep their row; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ragged, scratch, space_words

SEED = 42
SHARD = 8192
#: Pairs (query, node) that are compared at once, and rows of small buckets in one forest.
FRONT, FOREST = 2_000_000, 65_536


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """k-th further hash of a hash (k = 0: itself), by a 64-bit finaliser."""
    if not k:
        return h
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint_of(h: np.ndarray, words64: int = 1) -> bytes:
    out = []
    for k in range(words64):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 16):  # very long texts in bounded pieces
            ones += np.unpackbits(mixed(h[a : a + (1 << 16)], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def fingerprint(text: Column, *, shingle: int = 3, words64: int = 1, distinct: bool = False) -> Column:
    """Fingerprint (binary, 8 bytes for each of ``words64``). ``distinct``: count each different shingle once."""

    @F.pandas_udf("binary")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                h = shingle_hashes(space_words(t), shingle)
                out.append(fingerprint_of(np.unique(h) if distinct else h, words64))
            yield pd.Series(out, dtype=object)

    return prints(text)


def key_masks(bits: int, radius: int, *, blocks: int = 4, tables: int | None = None, key_bits: int = 16) -> list[np.ndarray]:
    """Bit positions of each table's key."""
    if tables is not None:
        rng = np.random.default_rng(SEED)
        return [np.sort(rng.choice(bits, key_bits, replace=False)) for _ in range(tables)]
    if blocks <= radius:
        raise ValueError("an exact search needs more blocks than differing bits")
    cut = np.array_split(np.arange(bits), blocks)
    return [np.concatenate([cut[i] for i in some]) for some in combinations(range(blocks), blocks - radius)]


def keyed(prints: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """t, key, fp: each fingerprint once in every table."""
    schema = pa.schema([("t", pa.int32()), ("key", pa.binary()), ("fp", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            if not len(fps):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1)
            for t, mask in enumerate(masks):
                keys = np.packbits(bits[:, mask], axis=1)
                rows = pa.array(list(map(bytes, keys)), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), rows, fps], schema=schema)

    return prints.select("fp").mapInArrow(emit, "t int, key binary, fp binary")


class Forest:
    """BK-trees of many groups. ``points``: (n, w) uint64; ``group``: tree number of each point."""

    def __init__(self, points: np.ndarray, group: np.ndarray):
        self.points, self.base = points, 64 * points.shape[1] + 1
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: sorted (parent node, edge) keys, node points
        index = np.arange(len(points))
        key = group.astype(np.int64)
        while len(index):
            order = np.argsort(key, kind="stable")
            index, key = index[order], key[order]
            new = np.diff(key, prepend=-1) != 0
            node = np.cumsum(new) - 1
            roots = index[new]
            self.levels.append((key[new], roots))
            rest = ~new
            index, node = index[rest], node[rest]
            key = node * self.base + self.distance(index, roots[node])

    def distance(self, a: np.ndarray, b: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        return np.bitwise_count((self.points if other is None else other)[a] ^ self.points[b]).sum(axis=1, dtype=np.int64)

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) pairs within the radius, a bounded number at a time."""
        roots = self.levels[0][0] if self.levels else np.zeros(0, np.int64)
        at = np.searchsorted(roots, group)
        there = at < len(roots)
        there[there] = roots[at[there]] == group[there]
        stack = [(0, q, at[q]) for q in np.array_split(np.flatnonzero(there), len(group) // FRONT + 1)]
        while stack:
            level, q, node = stack.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half]), (level, q[half:], node[half:])]
                continue
            point = self.levels[level][1][node]
            d = self.distance(q, point, queries)
            near = d <= radius
            if near.any():
                yield q[near], point[near]
            if level + 1 < len(self.levels):
                keys = self.levels[level + 1][0]
                low = np.searchsorted(keys, node * self.base + np.maximum(d - radius, 0))
                high = np.searchsorted(keys, node * self.base + np.minimum(d + radius, self.base - 1), "right")
                owner, child = ragged(low, high - low)
                if len(owner):
                    stack.append((level + 1, q[owner], child))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: smallest index of each component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        high, low = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def local_links(points: np.ndarray, tree: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Label of each point: the smallest index of its component. ``tree``: whether the point stands in its group's
    tree; all points search unless their group has others only in the tree (then these are searched for)."""
    label = np.arange(len(points))
    searched = np.flatnonzero(tree)
    asking = np.flatnonzero(~tree | ~np.isin(group, group[~tree]))
    forest = Forest(points[searched], group[searched])
    for q, p in forest.search(points[asking], group[asking], radius):
        label = merge_labels(label, asking[q], searched[p])
    return label


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b: links from each fingerprint to its component's first in the same bucket. Complete as to reachability."""
    spark = buckets.sparkSession
    heavy = buckets.groupBy("t", "key").count().where(F.col("count") > SHARD).select(F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("count") / SHARD).cast("int").alias("n"))
    dealt = (
        buckets.join(heavy, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left")
        .withColumn("s", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("n"))).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
        .select("t", "key", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), (F.col("s") >= F.col("o")).alias("tree"), "fp")
    )
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: pa.Table) -> pa.RecordBatch:
            fps = held.column("fp").to_pylist()
            points = np.frombuffer(b"".join(fps), ">u8").reshape(len(fps), -1).astype(np.uint64)
            label = local_links(points, held.column("tree").to_numpy(), held.column("g").to_numpy(), radius)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in linked], pa.binary()), pa.array([fps[i] for i in label[linked]], pa.binary())], schema=schema)

        waiting: list[pa.RecordBatch] = []
        last, number, rows = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in ("t", "key", "a", "b"))))
            groups = np.empty(len(names), np.int64)
            for i, name in enumerate(names):
                if name != last:
                    last, number = name, number + 1
                groups[i] = number
            numbered = pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("fp"), pa.array(groups)], names=["tree", "fp", "g"])
            waiting.append(numbered)
            rows += batch.num_rows
            if rows >= FOREST:  # the last group may go on in the next batch
                held = pa.Table.from_batches(waiting)
                full = int(np.searchsorted(held.column("g").to_numpy(), number))
                if full:
                    yield flush(held.slice(0, full))
                    waiting = held.slice(full).combine_chunks().to_batches()
                    rows -= full
        if rows:
            yield flush(pa.Table.from_batches(waiting))

    parts = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    return parts.mapInArrow(link, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of all linked nodes, by alternating star joins."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = around.join(low, "u")
        if large:  # larger neighbours move to the smallest
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    edges = scratch(links.where("a <> b").distinct())
    seen = None
    while True:
        edges = scratch(star(star(edges, True).where("a <> b"), False).where("a <> b"))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def linked_prints(prints: DataFrame, radius: int, words64: int, **keys) -> DataFrame:
    """prints: id, fp -> fp, component (smallest id reachable), one row for each different fingerprint."""
    different = scratch(prints.groupBy("fp").agg(F.min("id").alias("low")))
    masks = key_masks(64 * words64, radius, **keys)
    found = components(bucket_links(keyed(different, masks), radius))
    named = different.join(found, different.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    return named.join(lowest, "root").select("fp", "component")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, words64: int = 1, distinct: bool = False, **keys) -> DataFrame:
    """doc_id, fp, component of every row."""
    prints = scratch(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle=shingle, words64=words64, distinct=distinct).alias("fp")))
    named = linked_prints(prints, radius, words64, **keys)
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component")
