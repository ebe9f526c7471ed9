"""Windows over keys that may hold any share of the rows.

A plain ``partitionBy(key)`` window puts a whole key into one task. Here the rows of a key are cut
into contiguous segments and every heavy step runs on (key, segment):

1. counts per (key, time bucket) are aggregated with map-side combine;
2. a running sum over those few counts gives each bucket its row offset, so ``row_number`` inside a
   bucket plus the offset is the exact global row number of the key;
3. ``segment = (n - 1) div rows``: fixed-size, contiguous, independent of where the rows are.

Sliding frames copy the last ``lookback`` rows of a segment into the next one; running totals and
exponential sums carry one small row per segment. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.session import checkpoint_dir

SEGMENT_ROWS = 65_536


def number_rows(df: DataFrame, frame: Frame, bucket: Column, out: str = "n") -> DataFrame:
    """Exact 1-based row number per key; no task sees more than one (key, bucket).

    ``bucket`` must be non-decreasing in the order of the key (for example the hour of the timestamp).
    """
    keys = list(frame.keys)
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    prior = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(prior), F.lit(0))).drop("_c")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*frame.order)
    numbered = df.withColumn("_r", F.row_number().over(inner))
    return (
        numbered.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_r") + F.col("_off"))
        .drop("_bucket", "_r", "_off")
    )


def sliding(
    df: DataFrame,
    frame: Frame,
    lookback: int,
    op: Callable[[DataFrame, Frame], DataFrame],
    position: str = "n",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Run a bounded-lookback window operator per (key, segment) with a halo of earlier rows.

    ``op(df, frame)`` may look at most ``lookback`` rows back in the order of the key.
    """
    size = max(rows, lookback + 1)
    at = F.pmod(F.col(position) - 1, F.lit(size))
    seg = F.floor((F.col(position) - 1) / F.lit(size)).cast("bigint")
    copies = F.when(
        at >= size - lookback, F.array(seg, seg + 1)
    ).otherwise(F.array(seg))
    spread = df.withColumn("_seg", F.explode(copies)).withColumn("_halo", F.col("_seg") > seg)
    inner = Frame((*frame.keys, "_seg"), (position,))
    return op(spread, inner).filter(~F.col("_halo")).drop("_seg", "_halo")


_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def running(
    df: DataFrame,
    frame: Frame,
    outs: Mapping[str, tuple[str, Column]],
    position: str = "n",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Cumulative ``sum``/``max``/``min``/``count`` per key: local running value plus segment carry."""
    keys = list(frame.keys)
    df = df.withColumn("_seg", F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint"))
    totals = df.groupBy(*keys, "_seg").agg(
        *[_MERGE[kind](x).alias(f"_t_{o}") for o, (kind, x) in outs.items()]
    )
    prior = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        "_seg",
        *[_COMBINE[kind](f"_t_{o}").over(prior).alias(f"_c_{o}") for o, (kind, _) in outs.items()],
    )
    local = Window.partitionBy(*keys, "_seg").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    df = df.withColumns({f"_l_{o}": _MERGE[kind](x).over(local) for o, (kind, x) in outs.items()})
    joined = df.join(carry, [*keys, "_seg"])
    final: dict[str, Column] = {}
    for o, (kind, _) in outs.items():
        a, b = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        if kind in ("sum", "count"):
            final[o] = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        else:
            final[o] = F.greatest(a, b) if kind == "max" else F.least(a, b)
    joined = joined.withColumns(final)
    return joined.drop("_seg", *[f"_l_{o}" for o in outs], *[f"_c_{o}" for o in outs])


def ema(
    df: DataFrame,
    frame: Frame,
    x: Column,
    alphas: Mapping[str, float],
    position: str = "n",
) -> DataFrame:
    """First-value seeded EMA of a non-null series for keys of any size.

    A block of rows is weighted locally; blocks before the previous ones weigh below double precision.
    """
    import math

    from tideline.functions.smoothing import _LOG_EPS, block_rows

    keys = list(frame.keys)
    decays = {o: 1.0 - a for o, a in alphas.items()}
    rows = block_rows(list(decays.values()))
    df = df.withColumns(
        {
            "_blk": F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint"),
            "_k": F.pmod(F.col(position) - 1, F.lit(rows)).cast("double"),
        }
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sums: dict[str, Column] = {}
    for o, a in alphas.items():
        weight = F.when(F.col(position) == 1, F.lit(1.0)).otherwise(F.lit(a))
        d = F.lit(decays[o])
        sums[f"_l_{o}"] = F.sum(weight * x * F.pow(d, -F.col("_k"))).over(local) * F.pow(d, F.col("_k"))
    df = df.withColumns(sums)
    # One closing row per full block, shifted to the blocks that need it.
    closing = df.filter(F.col("_k") == rows - 1).select(*keys, "_blk", *sums)
    parts = []
    depth = {o: math.ceil(_LOG_EPS / (rows * -math.log(d))) for o, d in decays.items()}
    for j in range(1, max(depth.values()) + 1):
        parts.append(
            closing.select(
                *keys,
                (F.col("_blk") + j).alias("_blk"),
                *[
                    (F.col(f"_l_{o}") * (decays[o] ** (rows * (j - 1)) if j <= depth[o] else 0.0)).alias(f"_c_{o}")
                    for o in alphas
                ],
            )
        )
    carried = parts[0]
    for p in parts[1:]:
        carried = carried.unionByName(p)
    carried = carried.groupBy(*keys, "_blk").agg(*[F.sum(f"_c_{o}").alias(f"_c_{o}") for o in alphas])
    joined = df.join(carried, [*keys, "_blk"], "left")
    final = {
        o: F.col(f"_l_{o}")
        + F.pow(F.lit(decays[o]), F.col("_k") + 1) * F.coalesce(F.col(f"_c_{o}"), F.lit(0.0))
        for o in alphas
    }
    return joined.withColumns(final).drop("_blk", "_k", *sums, *[f"_c_{o}" for o in alphas])


def value_ranks(df: DataFrame, group: Sequence[str], value: str, splits: int = 64) -> DataFrame:
    """One row for each distinct non-null value of a group of any size: copies, rank_min, rank_avg, group_n.

    The histogram of distinct values (map-side combined) is checkpointed, so the input is read once; cuts, totals and ranks come
    from it. It is cut at approximate quantiles of the group so that no task orders a whole group; the cut points only place
    values, counts stay exact. Runs one Spark job while it is called.
    """
    group = list(group)
    checkpoint_dir(df.sparkSession)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("copies")).checkpoint()
    cuts = hist.groupBy(*group).agg(F.percentile_approx(value, [i / splits for i in range(1, splits)], 1000).alias("_cuts"))
    placed = hist.join(cuts, group).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(*group, "_b").agg(F.sum("copies").alias("_t"))
    over = Window.partitionBy(*group).orderBy("_b")
    totals = totals.select(
        *group,
        "_b",
        F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy(*group)).alias("group_n"),
    )
    inner = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_off") + F.coalesce(F.sum("copies").over(inner), F.lit(0))
    return placed.join(totals, [*group, "_b"]).withColumn("_before", before).select(
        *group, value, "copies", (F.col("_before") + 1).alias("rank_min"), (F.col("_before") + (F.col("copies") + 1) / F.lit(2.0)).alias("rank_avg"), "group_n"
    )


def group_rank(df: DataFrame, group: Sequence[str], value: str, splits: int = 64) -> DataFrame:
    """Average-tie rank and count of ``value`` within a group of any size (see ``value_ranks``).

    Adds ``rank_avg``, ``rank_min`` and ``group_n`` (non-null values). The input is read twice: for the histogram and for
    the join back, whose hot values AQE splits (a plain left join of rows with one row for each value).
    """
    return df.join(value_ranks(df, group, value, splits).drop("copies"), [*group, value], "left")


def percentiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], splits: int = 64) -> DataFrame:
    """Exact linear-interpolated percentiles per group of any size: ``out: p`` columns.

    The built-in exact percentile holds every distinct value of a group in one task. Here the distinct values carry their
    ranks (see ``value_ranks``; the input is read once), and each wanted position picks its two rows.
    """
    group = list(group)
    ranked = value_ranks(df, group, value, splits).withColumn("_hi", F.col("rank_min") + F.col("copies") - 1)
    aggs = []
    for out, p in probs.items():
        pos = F.lit(p) * (F.col("group_n") - 1) + 1
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda r: F.max(F.when((F.col("rank_min") <= r) & (F.col("_hi") >= r), F.col(value)))
        aggs += [at(lo).alias(f"_lo_{out}"), at(hi).alias(f"_hi_{out}"), F.max(pos - lo).alias(f"_w_{out}")]
    g = ranked.groupBy(*group).agg(*aggs)
    return g.select(
        *group,
        *[(F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_w_{o}")).alias(o) for o in probs],
    )
