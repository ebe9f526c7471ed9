"""Resampling without multiplied rows: replicates are drawn inside one pass over a group from hashes of counters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.segments import group_rank

#: Rows that one task permutes, and shifts of one arrangement.
BLOCK, SHIFTS = 65_536, 100
PRIME, ROOT = 2_147_483_647, 48_271


def multipliers(perms: int) -> list[int]:
    """One factor for each arrangement of a permutation test."""
    return [pow(ROOT, r + 1, PRIME) for r in range(-(-perms // SHIFTS))]


def shifted_products(x: np.ndarray, y: np.ndarray, key: np.ndarray, perms: int) -> np.ndarray:
    """Sum of x times a permuted y for each replicate. ``key``: one hash for each row, by which both are in order.

    Replicate b takes arrangement b div 100 (rows ordered by key * factor mod a prime) and shifts it cyclically; a prefix doubled in memory
    makes each shift a slice, so a replicate is one product of vectors.
    """
    n, out = len(x), np.zeros(perms)
    for r, factor in enumerate(multipliers(perms)):
        arranged = y[np.lexsort((np.arange(n), key % PRIME * factor % PRIME))]
        twice = np.concatenate((arranged, arranged))
        for s in range(min(SHIFTS, perms - r * SHIFTS)):
            shift = (1 + s * n // SHIFTS) % n
            out[r * SHIFTS + s] = x @ twice[shift : shift + n]
    return out


def correlation_of(product: Column, n: Column, mean: Column, sx: Column, sy: Column) -> Column:
    """Correlation of two rankings of the same n rows from the sum of their products."""
    return F.try_divide(product / n - mean * mean, sx * sy)


def permutation_test(pairs: DataFrame, by: Sequence[str], row: str, perms: int = 1000, seed: int = 42) -> DataFrame:
    """by, ic, n_obs, p_value, null_95 of the rank correlation of x and y. ``row``: a number of each row in its group.

    Both columns are ranked over the whole group once. Rows are then dealt to blocks by a hash of their number; a block is permuted in
    one task and sends one sum for each replicate. Permutations inside random blocks are permutations of the group, and no task
    sees more than a block: nothing is exploded by the number of replicates.
    """
    by = list(by)
    d = group_rank(group_rank(pairs.select(*by, row, "x", "y"), by, "x").withColumnRenamed("rank_avg", "rx").drop("rank_min", "group_n"), by, "y")
    d = d.withColumnRenamed("rank_avg", "ry").drop("rank_min")
    digest = F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in by], F.col(row).cast("string"), F.lit(str(seed))).cast("binary"))
    d = d.withColumn("_h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))
    d = d.withColumn("_block", F.col("_h") % F.ceil(F.col("group_n") / F.lit(BLOCK)))

    def permute(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", row])
        products = shifted_products(pdf["rx"].to_numpy(), pdf["ry"].to_numpy(), pdf["_h"].to_numpy(), perms)
        return pd.DataFrame({c: pdf[c].iloc[0] for c in by} | {"rep": np.arange(perms), "product": products})[[*by, "rep", "product"]]

    schema = T.StructType([d.schema[c] for c in by] + [T.StructField("rep", T.IntegerType()), T.StructField("product", T.DoubleType())])
    sums = d.groupBy(*by, "_block").applyInPandas(permute, schema).groupBy(*by, "rep").agg(F.sum("product").alias("product"))
    whole = d.groupBy(*by).agg(F.count("*").alias("n_obs"), F.sum(F.col("rx") * F.col("ry")).alias("_p"), F.stddev_pop("rx").alias("_sx"), F.stddev_pop("ry").alias("_sy"))
    ic = lambda p: correlation_of(F.col(p), F.col("n_obs"), (F.col("n_obs") + 1) / 2.0, F.col("_sx"), F.col("_sy"))
    whole = whole.withColumn("ic", ic("_p"))
    null = sums.join(whole, by).withColumn("_c", F.abs(ic("product")))
    g = null.groupBy(*by, "ic", "n_obs").agg(F.avg((F.col("_c") >= F.abs("ic")).cast("double")).alias("p_value"), F.percentile("_c", F.lit(0.95)).alias("null_95"))
    return whole.select(*by, "ic", "n_obs").join(g.select(*by, "p_value", "null_95"), by)


def stationary_picks(n: int, reps: np.ndarray, block: float, seed: int) -> np.ndarray:
    """(replicate, place) -> row, by the stationary bootstrap: runs of rows that go on with probability 1 - 1 / block, cyclic.

    Every number is a hash of (seed, replicate, place): a replicate is the same in any task and any order.
    """
    with np.errstate(over="ignore"):
        x = (reps.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
        for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(k)
        x ^= x >> np.uint64(32)
    fresh = (x >> np.uint64(40)).astype(np.float64) / float(1 << 24) < 1.0 / block
    fresh[:, 0] = True
    start = ((x & np.uint64((1 << 32) - 1)) % np.uint64(n)).astype(np.int64)
    at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
    return (np.take_along_axis(start, at, axis=1) + np.arange(n) - at) % n


def counted_ranks(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Average ranks of the rows in each resample, which holds row i ``counts[:, i]`` times."""
    _, place = np.unique(values, return_inverse=True)
    by_value = np.zeros((len(counts), place.max() + 1))
    np.add.at(by_value.T, place, counts.T)
    return (np.cumsum(by_value, axis=1) - by_value / 2 + 0.5)[:, place]


def bootstrap_correlations(x: np.ndarray, y: np.ndarray, boots: int, block: float, seed: int, cells: int = 1 << 22) -> np.ndarray:
    """Rank correlation of each resample. Resamples are rows of a count matrix, ``cells`` entries at a time; their ranks come from running counts."""
    n, out = len(x), np.full(boots, np.nan)
    step = max(1, cells // n)
    for a in range(0, boots, step):
        reps = np.arange(a, min(boots, a + step))
        picks = stationary_picks(n, reps, block, seed)
        counts = np.bincount((picks + np.arange(len(reps))[:, None] * n).ravel(), minlength=len(reps) * n).reshape(len(reps), n).astype(float)
        rx, ry = counted_ranks(x, counts) - (n + 1) / 2, counted_ranks(y, counts) - (n + 1) / 2
        with np.errstate(invalid="ignore", divide="ignore"):
            out[reps] = (counts * rx * ry).sum(axis=1) / np.sqrt((counts * rx**2).sum(axis=1) * (counts * ry**2).sum(axis=1))
    return out
