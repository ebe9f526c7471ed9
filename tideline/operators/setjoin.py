"""Exact similarity join of token sets: prefix, length and position filters.

Tokens are ordered from rare to frequent. Two sets at Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each,
so only these prefixes meet. Any one order of all tokens is right; how rare they are only decides how many pairs meet. It is taken from
``counts``, two arrays of fixed size that all tokens of all sets are counted in (a token's smaller count is never below its own), so each
set finds its prefix by itself: no other token is shuffled. Tokens of one prefix alone can't meet any and leave at once, and the others
meet where they are. A pair that met is dropped if its sizes differ too much, or if the tokens behind the last one met in both prefixes
can't make up the overlap that t asks for. What is left is compared by parity marks first, which bound the overlap from above at a twentieth of
the bytes, and in full after that; only sets that are still asked for are shuffled then.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import checkpoint_dir

#: Sets that share one prefix token in a task of the join.
BLOCK = 4096
#: Each of the two arrays has 2^BITS counts; they are added up in cells of 2^CELL.
BITS, CELL = 20, 13
#: Sets whose prefixes are taken at once.
ROWS = 256
#: Pairs of a cell, and sets of either side that one smallest partner brings to it.
PAIRS, PART = 1024, 512
#: A set has at least MARKS parity marks for each of its tokens; sets that are asked for are told apart by 2^ASKED slots of their ids.
MARKS, ASKED = 2, 21
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def slots(tokens: np.ndarray) -> list[np.ndarray]:
    """Where a token is counted in each of the two arrays."""
    return [((tokens.view(np.uint64) * np.uint64(f)) >> np.uint64(64 - BITS)).astype(np.int64) for f in FACTORS]


def lists(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """ids, sizes and tokens of ``ROWS`` sets at a time."""
    for lo in range(0, batch.num_rows, ROWS):
        some = batch.slice(lo, ROWS)
        tokens = some.column("tokens")
        yield some.column("id"), pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64), tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def counts(sets: DataFrame) -> list[np.ndarray]:
    """The two arrays over all tokens of all sets: 16 MB, whatever the sets are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(2 << BITS, np.int64)
        for batch in batches:
            for _, _, tokens in lists(batch):
                for k, at in enumerate(slots(tokens)):
                    np.add.at(own, at + (k << BITS), 1)
        if own.any():
            cells = [c.astype(np.min_scalar_type(c.max())) for c in own.reshape(-1, 1 << CELL)]  # a task's counts are small: mostly a byte each
            width, own = pa.array([c.itemsize for c in cells], pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), width, own], names=["cell", "width", "own"])

    def add(some: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(c, f"u{w}").astype(np.int64) for w, c in zip(some["width"], some["own"])), np.zeros(1 << CELL, np.int64))
        return pd.DataFrame({"cell": some["cell"].iloc[:1], "total": [total.tobytes()]})

    cells = sets.select("id", "tokens").mapInArrow(run, "cell int, width int, own binary").groupBy("cell").applyInPandas(add, "cell int, total binary").collect()
    out = np.zeros(2 << BITS, np.int64)
    for c in cells:
        out[c.cell << CELL : (c.cell + 1) << CELL] = np.frombuffer(c.total, np.int64)
    return list(out.reshape(2, -1))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """token, id, n, pos, times: the prefix tokens that are in other prefixes too. ``sets``: id, tokens (distinct longs). Runs a job when called."""
    sent = sets.sparkSession.sparkContext.broadcast(counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = sent.value
        for batch in batches:
            for ids, n, tokens in lists(batch):
                owner = np.repeat(np.arange(len(n)), n)
                at = slots(tokens)
                order = np.lexsort((tokens, np.minimum(first[at[0]], second[at[1]]), owner))
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) + 1
                mine = np.flatnonzero(pos <= (n - np.ceil(threshold * n - 1e-9) + 1)[owner])
                cols = [pa.array(tokens[order[mine]]), ids.take(pa.array(owner[mine])), pa.array(n[owner[mine]].astype(np.int32)), pa.array(pos[mine].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "id", "n", "pos"])

    kind = sets.schema["id"].dataType.simpleString()
    flat = sets.select("id", "tokens").mapInArrow(run, f"token bigint, id {kind}, n int, pos int")
    return flat.withColumn("times", F.count("*").over(Window.partitionBy("token"))).filter("times > 1")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """id_a < id_b of every pair that may reach the threshold. A token's sets meet in one place, or each two blocks of about ``BLOCK`` of them
    where they are more. Runs jobs when called."""
    parts = F.ceil(F.col("times") / F.lit(BLOCK)).cast("int")
    p = prefixes(sets, threshold).withColumn("_k", F.pmod(F.xxhash64("id"), parts).cast("int"))
    p = p.select("token", "id", "n", "pos", "_k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_o"))
    p = p.select("token", F.least("_k", "_o").alias("_lo"), F.greatest("_k", "_o").alias("_hi"), "id", "n", "pos", "_k").repartition("token", "_lo", "_hi")
    side = lambda c: F.collect_list(F.when(F.col("_k") == F.col(c), F.struct("id", "n", "pos")))
    m = p.groupBy("token", "_lo", "_hi").agg(side("_lo").alias("_x"), side("_hi").alias("_y"))
    m = m.select("_lo", "_hi", F.explode("_x").alias("_x"), "_y").select("_lo", "_hi", "_x", F.explode("_y").alias("_y"))
    m = m.filter((F.col("_x.id") < F.col("_y.id")) | ((F.col("_lo") < F.col("_hi")) & (F.col("_x.id") > F.col("_y.id"))))
    m = m.filter(F.least("_x.n", "_y.n") >= threshold * F.greatest("_x.n", "_y.n") - 1e-9)
    end = lambda c, s, t: F.when(F.col("_x.id") < F.col("_y.id"), F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}"))
    met = m.select(*[end(c, *s).alias(f"{c}_{e}") for e, s in (("a", ("_x", "_y")), ("b", ("_y", "_x"))) for c in ("id", "n", "pos")])
    met = met.groupBy("id_a", "id_b", F.col("n_a").alias("na"), F.col("n_b").alias("nb")).agg(F.count("*").alias("_met"), F.max("pos_a").alias("_pa"), F.max("pos_b").alias("_pb"))
    needed = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    return met.filter(F.col("_met") + F.least(F.col("na") - F.col("_pa"), F.col("nb") - F.col("_pb")) >= needed).select("id_a", "id_b")


def cells(pairs: DataFrame) -> DataFrame:
    """id_a, id_b and the cell (``_c``, ``_qa``, ``_qb``) in which a pair is compared. Pairs whose second set has the same smallest partner go
    together, so copies of one text need each set once and not once per pair; one partner's sets are cut to parts of about ``PART``."""
    some = max(-(-pairs.count() // PAIRS), 1)
    led = pairs.join(pairs.groupBy("id_b").agg(F.min("id_a").alias("_lead")), "id_b")
    parts = lambda c: F.ceil(F.count_distinct(c) / F.lit(PART)).cast("int")
    led = led.join(led.groupBy("_lead").agg(parts("id_a").alias("_na"), parts("id_b").alias("_nb")), "_lead")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    return led.select("id_a", "id_b", F.pmod(F.xxhash64("_lead"), F.lit(some)).cast("int").alias("_c"), part("id_a", "_na").alias("_qa"), part("id_b", "_nb").alias("_qb"))


def in_cells(pairs: DataFrame, items: DataFrame, judge: Callable, schema: T.StructType) -> DataFrame:
    """``judge(pairs, items)`` of every cell, with the items (id and more) that its pairs name."""
    placed = cells(pairs).checkpoint()
    key = ["_c", "_qa", "_qb"]
    own = [f"{k}2" for k in key]
    wanted = placed.select(*key, F.col("id_a").alias("id")).union(placed.select(*key, F.col("id_b").alias("id"))).distinct()
    needed = wanted.join(items, "id").select(*[F.col(k).alias(o) for k, o in zip(key, own)], *items.columns)
    return placed.groupBy(*key).cogroup(needed.groupBy(*own)).applyInPandas(judge, schema)


def marks(tokens: np.ndarray) -> bytes:
    """For each of a power of two of slots, whether an odd number of tokens falls into it."""
    bits = max(math.ceil(math.log2(max(MARKS * len(tokens), 1))), 3)
    at = (tokens.view(np.uint64) * np.uint64(FACTORS[0])) >> np.uint64(64 - bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=1 << bits) & 1).tobytes()


def folded(own: np.ndarray, size: int) -> np.ndarray:
    """Marks as ``size`` bytes: neighbouring slots become one."""
    if len(own) == size:
        return own
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(own).reshape(size * 8, -1), axis=1))


def screened(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose overlap may be large enough by their marks. Marks that differ are tokens that only one set has, so no
    pair at the threshold is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, tokens in lists(batch):
                made = [marks(t) for t in np.split(tokens, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(made, pa.binary())], names=["id", "n", "marks"])

    def judge(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = {i: (n, np.frombuffer(m, np.uint8)) for i, n, m in zip(held["id"], held["n"], held["marks"])}
        keep = np.zeros(len(some), bool)
        for k, (a, b) in enumerate(zip(some["id_a"], some["id_b"])):
            (na, x), (nb, y) = own[a], own[b]
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
            keep[k] = na + nb - apart >= 2 * math.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
        return some.loc[keep, ["id_a", "id_b"]]

    kind = sets.schema["id"].dataType.simpleString()
    return in_cells(pairs, sets.select("id", "tokens").mapInArrow(run, f"id {kind}, n bigint, marks binary"), judge, pairs.schema)


def asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``sets`` without most of those that no pair names. What is broadcast has 2^``ASKED`` rows of one number at most; slots are shared, so the
    exact join comes after."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ASKED)).alias("_slot")
    named = pairs.select(slot("id_a")).union(pairs.select(slot("id_b"))).distinct()
    return sets.withColumn("_slot", slot("id")).join(F.broadcast(named), "_slot", "left_semi").drop("_slot")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """id_a, id_b, similarity of all pairs of sets at the threshold or above, each once. ``sets``: id (unique), tokens (distinct longs). Runs jobs
    when called."""
    checkpoint_dir(sets.sparkSession)
    pairs = screened(candidates(sets, threshold).checkpoint(), sets, threshold).checkpoint()
    schema = T.StructType([*pairs.schema, T.StructField("similarity", T.DoubleType())])

    def compare(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        tokens = dict(zip(held["id"], map(np.sort, held["tokens"])))
        out = []
        for a, b in zip(some["id_a"], some["id_b"]):
            x, y = tokens[a], tokens[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        found = some[["id_a", "id_b"]].assign(similarity=np.array(out, float))
        return found[found["similarity"] >= threshold]

    return in_cells(pairs, asked(sets.select("id", "tokens"), pairs), compare, schema)
