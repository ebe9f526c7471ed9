"""Exponential smoothing as window sums (no Python worker, no per-key loop).

``y_t = sum_i d**(n_t - n_i) * v_i`` is computed as ``d**k * sum(v_i * d**-k_i)`` over a block of rows,
with the block length chosen so that ``d**-k`` stays inside double range. Blocks before the previous
few weigh less than 1e-19 of the value, so a fixed number of earlier block totals completes the sum to
double precision. All windows share the key partitioning: one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div

_LOG_RANGE = 600.0
_LOG_EPS = 45.0


def block_rows(decays: list[float]) -> int:
    return max(8, int(_LOG_RANGE / max(-math.log(d) for d in decays)))


def in_blocks(df: DataFrame, position: str, decays: list[float]) -> tuple[DataFrame, int]:
    """Add ``_blk`` and ``_k``, the block of a row and its place there, and give the rows of a block.

    Passes that share these columns share one sort.
    """
    rows = block_rows(decays)
    return df.withColumns(
        {
            "_blk": F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint"),
            "_k": F.pmod(F.col(position) - 1, F.lit(rows)).cast("double"),
        }
    ), rows


def block_sums(
    df: DataFrame,
    frame: Frame,
    seen: Column,
    position: str,
    rows: int,
    specs: Mapping[str, tuple[Col, float]],
) -> DataFrame:
    """``out = sum_i d**(n_t-n_i) * value_i`` over the rows ``seen``, which ``position`` counts, in the blocks of ``in_blocks``."""
    block = Window.partitionBy(*frame.keys, "_blk").orderBy(*frame.order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local: dict[str, Column] = {}
    for i, (value, d) in enumerate(specs.values()):
        term = F.when(seen, col(value).cast("double") * F.pow(F.lit(d), -F.col("_k")))
        local[f"_loc{i}"] = F.sum(term).over(block) * F.pow(F.lit(d), F.col("_k"))
    df = df.withColumns(local)
    by_block = Window.partitionBy(*frame.keys).orderBy("_blk")
    final: dict[str, Column] = {}
    for i, (out, (_, d)) in enumerate(specs.items()):
        closing = F.when((F.col("_k") == rows - 1) & seen, F.col(f"_loc{i}"))
        carry: Column = F.lit(0.0)
        for j in range(1, math.ceil(_LOG_EPS / (rows * -math.log(d))) + 1):
            earlier = F.max(closing).over(by_block.rangeBetween(-j, -j))
            carry = carry + F.coalesce(earlier, F.lit(0.0)) * (d ** (rows * (j - 1)))
        final[out] = F.when(
            F.col(position) > 0, F.col(f"_loc{i}") + F.pow(F.lit(d), F.col("_k") + 1) * carry
        )
    return df.withColumns(final).drop(*local)


def decayed_sums(
    df: DataFrame,
    frame: Frame,
    observed: Col,
    specs: Mapping[str, tuple[Col, float]],
    position: str | None = None,
) -> DataFrame:
    """Add ``out = sum_i d**(n_t-n_i) * value_i`` for each ``out: (value, d)``.

    ``n`` counts the rows where ``observed`` is non-null; other rows repeat the previous result.
    ``position`` names an existing column that already holds ``n`` (used by the split-key variant).
    """
    n = position or "_n"
    if position is None:
        df = df.withColumn("_n", F.count(col(observed)).over(frame.cum))
    df, rows = in_blocks(df, n, [d for _, d in specs.values()])
    df = block_sums(df, frame, col(observed).isNotNull(), n, rows, specs)
    return df.drop("_blk", "_k", *([] if position else ["_n"]))


def decayed_by_key(df: DataFrame, frame: Frame, position: str, value: Col, decay: Col, out: str, fastest: float) -> DataFrame:
    """``decayed_sums`` with a decay that is a column, the same on all rows of a key (many rates in one pass).

    ``position`` counts the observed rows from 1 (0 before the first); ``value`` is non-null on them only. ``fastest`` is the
    smallest decay that occurs; it sets the block length, and earlier blocks (a few for each key) are folded in order.
    """
    rows = block_rows([fastest])
    d = col(decay)
    df = df.withColumns({"_blk": F.floor((F.col(position) - 1) / F.lit(rows)).cast("bigint"), "_k": F.pmod(F.col(position) - 1, F.lit(rows)).cast("double")})
    block = Window.partitionBy(*frame.keys, "_blk").orderBy(*frame.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_loc", F.sum(col(value).cast("double") * F.pow(d, -F.col("_k"))).over(block) * F.pow(d, F.col("_k")))
    closing = F.when((F.col("_k") == rows - 1) & col(value).isNotNull(), F.col("_loc"))
    before = F.collect_list(closing).over(Window.partitionBy(*frame.keys).orderBy("_blk").rangeBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_old", before)
    carry = F.aggregate("_old", F.lit(0.0), lambda acc, x: acc * F.pow(d, F.lit(float(rows))) + x)
    return df.withColumn(out, F.when(F.col(position) > 0, F.col("_loc") + F.pow(d, F.col("_k") + 1) * carry)).drop("_blk", "_k", "_loc", "_old")


def ewm_mean(
    df: DataFrame, frame: Frame, x: Col, alphas: Mapping[str, float]
) -> DataFrame:
    """Recursive mean seeded with the first non-null value; several alphas of one input at once."""
    df = df.withColumns({"_x": col(x).cast("double"), "_nx": F.count(col(x)).over(frame.cum)})
    specs = {
        out: (F.when(F.col("_nx") == 1, F.col("_x")).otherwise(F.col("_x") * a), 1.0 - a)
        for out, a in alphas.items()
    }
    return decayed_sums(df, frame, "_x", specs, position="_nx").drop("_x", "_nx")


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


def ewm_columns(
    df: DataFrame, frame: Frame, observed: Col, outs: Mapping[str, tuple[Col, float]]
) -> DataFrame:
    """Recursive means of several inputs that are non-null on the same rows (``observed``): one pass."""
    df = df.withColumns({"_ob": col(observed), "_nx": F.count(col(observed)).over(frame.cum)})
    specs = {
        out: (F.when(F.col("_nx") == 1, col(x).cast("double")).otherwise(col(x).cast("double") * a), 1.0 - a)
        for out, (x, a) in outs.items()
    }
    return decayed_sums(df, frame, "_ob", specs, position="_nx").drop("_ob", "_nx")


def ewm_span(df: DataFrame, frame: Frame, x: Col, spans: Mapping[str, int]) -> DataFrame:
    return ewm_mean(df, frame, x, {out: span(n) for out, n in spans.items()})


def ema_seeded(
    df: DataFrame,
    frame: Frame,
    x: Col,
    out: str,
    alpha: float,
    min_periods: int,
) -> DataFrame:
    """EMA seeded with the mean of the first window of ``min_periods`` non-null values.

    A NULL input repeats the previous value; rows before the seed are NULL.
    """
    return emas_seeded(df, frame, x, {out: (alpha, min_periods)})


def emas_seeded(df: DataFrame, frame: Frame, x: Col, outs: Mapping[str, tuple[float, int]]) -> DataFrame:
    """``ema_seeded`` of one input for each ``out: (alpha, min_periods)``, all in the same two sorts.

    Rows count by the input's non-null values for all of them; a row before its seed weighs nothing.
    """
    df = df.withColumns({"_x0": col(x).cast("double"), "_nx": F.count(col(x)).over(frame.cum)})
    full = {o: F.count("_x0").over(frame.last_rows(m)) >= m for o, (_, m) in outs.items()}
    df = df.withColumns({f"_f{i}": full[o] for i, o in enumerate(outs)} | {f"_a{i}": F.avg("_x0").over(frame.last_rows(m)) for i, (_, m) in enumerate(outs.values())})
    df = df.withColumns({f"_s{i}": F.sum(F.col(f"_f{i}").cast("int")).over(frame.cum) for i in range(len(outs))})
    specs = {
        o: (F.when(F.col(f"_f{i}") & (F.col(f"_s{i}") == 1), F.col(f"_a{i}")).when(F.col(f"_s{i}") > 0, F.col("_x0") * a), 1.0 - a)
        for i, (o, (a, _)) in enumerate(outs.items())
    }
    df = decayed_sums(df, frame, "_x0", specs, position="_nx")
    df = df.withColumns({o: F.when(F.col(f"_s{i}") > 0, F.col(o)) for i, o in enumerate(outs)})
    return df.drop("_x0", "_nx", *[f"_{c}{i}" for c in "fas" for i in range(len(outs))])


def ewm_std(df: DataFrame, frame: Frame, x: Col, out: str, n: int) -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation (weights summing from the start)."""
    d = 1.0 - span(n)
    df = df.withColumn("_v", col(x).cast("double"))
    df = decayed_sums(
        df,
        frame,
        "_v",
        {
            "_s0": (F.lit(1.0), d),
            "_s1": (F.col("_v"), d),
            "_s2": (F.col("_v") * F.col("_v"), d),
            "_q0": (F.lit(1.0), d * d),
        },
    )
    m = F.col("_s1") / F.col("_s0")
    var = F.col("_s2") / F.col("_s0") - m * m
    bias = div(F.col("_s0") * F.col("_s0"), F.col("_s0") * F.col("_s0") - F.col("_q0"))
    value = F.when(
        F.col("_s0") > 1.0, F.sqrt(F.greatest(var * bias, F.lit(0.0)))
    )
    return df.withColumn(out, value).drop("_v", "_s0", "_s1", "_s2", "_q0")
