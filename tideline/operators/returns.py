"""Returns on two tracks (all rows, and canonical bar closes) and their normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div, ln_ratio


def bar_returns(
    bars: DataFrame, keys: Sequence[str] = ("id", "tf"), ts: str = "ts", roll: str = "is_partial_end"
) -> DataFrame:
    """gap, first/second difference, arithmetic/log return, range and true range.

    ``*_roll`` columns step over every row of the key; the plain ones step from one bar close to the
    next and are NULL on intra-bar rows. Both windows use the key partitioning: one shuffle.
    """
    every = Frame(keys, (ts,))
    same = Frame((*keys, roll), (ts,))
    df = bars.withColumns(
        {
            "_pcu": every.lag("close"),
            "_pcc": F.when(~F.col(roll), same.lag("close")),
            "_pseq": F.when(~F.col(roll), same.lag("bar_seq")),
        }
    ).filter(F.col("_pcu").isNotNull())
    cols: dict[str, Column] = {"gap_bars": F.col("bar_seq") - F.col("_pseq")}
    for suffix, prev in (("_roll", F.col("_pcu")), ("", F.col("_pcc"))):
        tr = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        )
        have = prev.isNotNull()
        rng = F.when(have, F.col("high") - F.col("low"))
        cols |= {
            f"delta1{suffix}": F.col("close") - prev,
            f"ret_arith{suffix}": div(F.col("close"), prev) - 1,
            f"ret_log{suffix}": ln_ratio("close", prev),
            f"range{suffix}": rng,
            f"range_pct{suffix}": div(rng, "close"),
            f"true_range{suffix}": F.when(have, tr),
            f"true_range_pct{suffix}": div(F.when(have, tr), "close"),
        }
    df = df.withColumns(cols)
    second = {}
    for base, out in (("delta1", "delta2"), ("ret_arith", "delta_ret_arith"), ("ret_log", "delta_ret_log")):
        second[f"{out}_roll"] = every.diff(f"{base}_roll")
        second[out] = F.when(~F.col(roll), same.diff(base))
    return df.withColumns(second).drop("_pcu", "_pcc", "_pseq")


def value_returns(
    df: DataFrame, value: str, keys: Sequence[str], ts: str = "ts", roll: str | None = None, prefix: str | None = None
) -> DataFrame:
    """delta, arithmetic and log returns of any value column (EMA, AMA) per key, canonical and all rows."""
    p = prefix or value
    f = Frame(keys, (ts,))
    out = {
        f"{p}_delta_roll": f.diff(value),
        f"{p}_ret_arith_roll": f.pct(value),
        f"{p}_ret_log_roll": f.log_return(value),
    }
    if roll is not None:
        c = Frame((*keys, roll), (ts,))
        out |= {
            f"{p}_delta": F.when(~F.col(roll), c.diff(value)),
            f"{p}_ret_arith": F.when(~F.col(roll), c.pct(value)),
            f"{p}_ret_log": F.when(~F.col(roll), c.log_return(value)),
        }
    return df.withColumns(out)


def changes(
    df: DataFrame,
    frame: Frame,
    cols: Sequence[str],
    kinds: Sequence[str] = ("pct", "log"),
    newest_first: bool = False,
    round_places: int | None = None,
) -> DataFrame:
    """Bar-to-bar change columns. ``newest_first`` tables step towards the following row instead."""
    out: dict[str, Column] = {}
    for c in cols:
        prev = frame.lead(c) if newest_first else frame.lag(c)
        for kind in kinds:
            v = div(c, prev) - 1 if kind == "pct" else ln_ratio(c, prev)
            out[f"{c}_{kind}_delta"] = v if round_places is None else F.round(v, round_places)
    return df.withColumns(out)


def intraday_changes(open_: Col = "open", high: Col = "high", low: Col = "low", close: Col = "close") -> dict[str, Column]:
    return {
        "open_close_pct": div(close, open_) - 1,
        "open_close_log": ln_ratio(close, open_),
        "range_pct": div(col(high) - col(low), open_),
    }


def daily_returns(df: DataFrame, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    f = Frame(keys, (ts,))
    return df.withColumns(
        {
            "gap_days": F.datediff(ts, f.lag(ts)),
            "ret_arith": f.pct("close"),
            "ret_log": f.log_return("close"),
        }
    ).filter(F.col("gap_days").isNotNull())


def return_zscores(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("id", "tf"),
    ts: str = "ts",
    days: Sequence[int] = (30, 90, 365),
    tf_days: int = 1,
    min_bars: int = 30,
    outlier: float = 4.0,
) -> DataFrame:
    """Rolling z-scores over day windows turned into bars; windows under ``min_bars`` bars are skipped."""
    f = Frame(keys, (ts,))
    out: dict[str, Column] = {}
    for d in days:
        bars = round(d / tf_days)
        if bars >= min_bars:
            for c in cols:
                out[f"{c}_z{d}"] = f.zscore(c, bars)
    df = df.withColumns(out)
    extreme = F.greatest(*[F.abs(F.col(c)) for c in out], F.lit(0.0))
    return df.withColumn("is_outlier", extreme > outlier)


def cross_section_norms(
    df: DataFrame, value: str, by: Sequence[str] = ("ts",), min_assets: int = 5
) -> DataFrame:
    """z-score and percent rank of ``value`` among the assets of one timestamp.

    The rank uses the split-group counter, so a timestamp holding a large share of the rows is spread
    over tasks; mean and deviation are a map-side combined aggregate.
    """
    from tideline.plans.segments import group_rank

    by = list(by)
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n_assets")
    )
    ranked = group_rank(df.join(stats, by), by, value)
    ok = F.col("n_assets") >= min_assets
    return ranked.withColumns(
        {
            f"{value}_cs_z": F.when(ok, div(F.col(value) - F.col("_m"), F.col("_s"))),
            f"{value}_cs_rank": F.when(ok, div(F.col("rank_min") - 1, F.col("n_assets") - 1)),
        }
    ).drop("_m", "_s", "rank_min", "rank_avg", "group_n")


def binarize(x: Col, threshold: float = 0.0) -> Column:
    return (col(x) > threshold).cast("int")


def union_variants(tables: Mapping[str, DataFrame], name: str = "alignment_source") -> DataFrame:
    """One table out of the alignment variants, tagged with where each row came from."""
    out: DataFrame | None = None
    for source, df in tables.items():
        tagged = df.withColumn(name, F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    assert out is not None
    return out


def rank_window(by: Sequence[str], order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order))
