"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. ``size`` coordinates are filled in rounds: in each of the first ``size`` rounds every shingle is thrown into one coordinate by
that round's hash, and a coordinate keeps the least hash of the first round that reached it. Coordinates that are still empty get the
least hash of all shingles in a round of their own, so every set, however small, fills all of them; two sets agree in a coordinate
with the probability of their Jaccard similarity, and the share that agrees is concentrated about it. A set of n shingles costs
n + size log(size) hashes and not n size.

Bands of ``ROWS`` coordinates are bucket keys. At similarity 0.8 a pair shares none of the 32 bands with 5e-8 (computed for independent
coordinates); nothing else in this module loses a link.

Links. Equal sets collapse to one node. In every bucket each node is paired with the bucket's smallest, and different pairs are compared by
their full sets (``verified``: the sets of a popular smallest node are dealt to several tasks, which hold its set only). Components of these
links settle most buckets. In a bucket that still holds several components, nodes of different components are compared in full, in blocks of
``BLOCK`` shingles (``crossing``); no pairs are written out. A bucket of n sets that are like each other, but below the limit, costs up
to n^2 comparisons, shared over its block pairs. Star joins connect the links. Sets are compared by 64-bit hashes of their shingles.

Defined results. Texts without words (null, empty or spaces) have 0 shingles and are linked with nothing. Repeated rows are links and
stay rows. A component's id is its smallest id that is not null; a row without id is never kept. An empty table gives no rows. Very long
texts are one set of any size (a block of their own). Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ragged, scratch, space_words
from tideline.llm.simhash import components, merge_labels, mixed, shingle_hashes

#: Link at similarity of this fraction or more.
LEAST = (4, 5)
SIZE, ROWS = 128, 4
#: Members of one smallest node that a task compares, and shingles of a block.
MEMBERS, BLOCK = 4096, 1_000_000
NONE = np.uint64(2**64 - 1)


def thrown(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """(round, shingle) -> 64-bit hash of a shingle in a round."""
    return mixed(h[None, :] + (rounds.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None], 1)


def placed(hashes: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Order within a coordinate: first the round, then the hash."""
    return (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (hashes >> np.uint64(16))


def sketch(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Coordinates of a set of 64-bit hashes that isn't empty. ``size``: a power of 2, up to 2^15."""
    out = np.full(size, NONE)
    done = 0
    while done < size and (out == NONE).any():
        rounds = np.arange(done, min(size, done + max(1, 4 * size // len(h))))
        hashes = thrown(h, rounds)
        np.minimum.at(out, (hashes & np.uint64(size - 1)).ravel().astype(np.intp), placed(hashes, rounds).ravel())
        done += len(rounds)
    empty = np.flatnonzero(out == NONE)
    if len(empty):
        out[empty] = placed(thrown(h, size + empty), size + empty).min(axis=1)
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    cut = coordinates.reshape(-1, rows)
    key = np.arange(1, len(cut) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key ^ cut[:, k], 1)
    return key


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(space_words(text), shingle))


def described(text: Column, shingle: int) -> Column:
    """sid (digest of the set), n, keys of each text; no sid without words."""

    @F.pandas_udf("sid binary, n long, keys array<bigint>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_set(t, shingle)
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), bands(sketch(h)).view(np.int64)) if len(h) else (None, 0, []))
            yield pd.DataFrame(rows, columns=["sid", "n", "keys"])

    return describe(text)


def bucket_pairs(keys: DataFrame) -> DataFrame:
    """key, lead, lead_n, node, n: the smallest node of each bucket with each of its others. ``keys``: key, node, n."""
    names = ["key", "lead", "lead_n", "node", "n"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # key, smallest node and its size of the bucket that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, n = (np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns))
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            rest = ~first
            yield pa.RecordBatch.from_arrays([pa.array(c[rest]) for c in (k, v[lead], n[lead], v, n)], names=names)
            held = np.array([k[-1:], v[lead[-1:]], n[lead[-1:]]])

    return keys.select("key", "node", "n").repartition("key").sortWithinPartitions("key", "node").mapInArrow(pair, "key long, lead long, lead_n long, node long, n long")


def near(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = LEAST
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs whose sets are near. ``pairs``: lead, node, each once; ``sets``: id, h."""
    up, down = LEAST
    most = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    several = most.where("parts > 1").select(F.col("lead").alias("l"), "parts")
    dealt = pairs.join(several, F.col("lead") == F.col("l"), "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int"))
    members = dealt.select("lead", "part", F.col("node").alias("id")).join(sets, "id").select("lead", "part", F.lit(1).alias("kind"), "id", "h")
    leads = most.select(F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets, "id")
    rows = leads.select(F.col("id").alias("lead"), "part", F.lit(0).alias("kind"), "id", "h").union(members)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            lead, _, kind, node, h = batch.columns
            for a, k, b, packed in zip(lead.to_pylist(), kind.to_pylist(), node.to_pylist(), h):
                other = np.frombuffer(packed.as_buffer(), np.uint64)
                if not k:
                    mine = other.copy()
                elif near(mine, other):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "kind").mapInArrow(check, "a long, b long")


def across(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Labels (indices) after linking near sets of different labels, given labels of components that are known."""
    up, down = LEAST
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    postings, counts = np.repeat(np.arange(n), sizes)[order], np.bincount(shingle)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    most = np.bincount(label).argmax()
    for i in np.flatnonzero(label != most):  # pairs inside the largest component are linked already
        mine = shingle[ends[i] - sizes[i] : ends[i]]
        both = np.bincount(postings[ragged(starts[mine], counts[mine])[1]], minlength=n)
        linked = np.flatnonzero(down * both >= up * (sizes + sizes[i] - both))
        label = merge_labels(label, np.full(len(linked), i), linked)
    return label


def crossing(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: components to be joined, as near sets of both share a bucket. ``rows``: key, node, n, root of buckets with several roots."""
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        rows.join(blocks, "key")
        .withColumn("s", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks <= 1 OR s <> o")
        .select("key", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), "root", F.col("node").alias("id"))
        .join(sets, "id")
        .select("key", "x", "y", "root", "h")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, roots, held = None, [], []

        def flush() -> pa.RecordBatch:
            names, label = np.unique(np.array(roots, np.int64), return_inverse=True)
            _, at = np.unique(label, return_index=True)
            pairs = np.zeros((0, 2), np.int64)
            if len(names) > 1:
                after = across(held, at[label])
                pairs = np.unique(np.column_stack((names[label], names[label[after]])), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            key, x, y, root, h = batch.columns
            for k, i, j, r, packed in zip(key.to_pylist(), x.to_pylist(), y.to_pylist(), root.to_pylist(), h):
                if (k, i, j) != last:
                    if held:
                        yield flush()
                    last, roots, held = (k, i, j), [], []
                roots.append(r)
                held.append(np.frombuffer(packed.as_buffer(), np.uint64).copy())
        if held:
            yield flush()

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(link, "a long, b long")


def linked(different: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """node, root of the nodes that are linked. ``different``: node, n, keys; ``texts``: node, text."""
    up, down = LEAST
    shared = scratch(bucket_pairs(different.select(F.explode("keys").alias("key"), "node", "n")))
    members = shared.select("key", "node", "n").union(shared.select("key", F.col("lead").alias("node"), F.col("lead_n").alias("n")).distinct())

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([shingle_set(t, shingle).tobytes() for t in some], dtype=object)

    sets = scratch(texts.join(members.select("node").distinct(), "node").select(F.col("node").alias("id"), packed("text").alias("h")))
    close = F.least("n", "lead_n") * down >= F.greatest("n", "lead_n") * up
    found = scratch(components(verified(shared.where(close).select("lead", "node").distinct(), sets)))
    rooted = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).where("low <> high AND c > 2")
    unsettled = scratch(rooted.join(open_keys, "key", "left_semi").select("key", "node", "n", "root"))
    more = components(crossing(unsettled, sets)).select(F.col("node").alias("old"), F.col("root").alias("new"))
    lone = more.join(found.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    moved = found.join(more, found.root == more.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved.union(lone)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    text = F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"), described(text, shingle).alias("d"))
    tagged = scratch(rows.select("row", "id", "text", "d.*"))
    different = scratch(tagged.where("n > 0").groupBy("sid").agg(F.min("row").alias("node"), F.min("id").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    found = linked(different.select("node", "n", "keys"), tagged.select(F.col("row").alias("node"), "text"), shingle)
    named = scratch(different.select("sid", "node", "low").join(found, "node", "left").select("sid", "low", F.coalesce("root", "node").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    by_set = named.join(lowest, "root").select("sid", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = tagged.select("sid", "id", "n").join(by_set, "sid", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
