"""Event filters and forward-looking labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div, ln_ratio
from tideline.functions.smoothing import ewm_std
from tideline.plans.scan import scan


def cusum_marks(steps: np.ndarray, threshold: float) -> np.ndarray:
    """True where the running up or down sum of steps reaches the threshold; that sum restarts."""
    hit = np.zeros(len(steps), dtype=bool)
    if not threshold > 0:
        return hit
    up = dn = 0.0
    for i, v in enumerate(steps.tolist()):
        if v != v:
            continue
        up = max(0.0, up + v)
        dn = min(0.0, dn + v)
        if up >= threshold:
            up, hit[i] = 0.0, True
        elif dn <= -threshold:
            dn, hit[i] = 0.0, True
    return hit


def cusum_thresholds(df: DataFrame, f: Frame, mult: float = 2.0, n: int = 100, x: str = "close") -> DataFrame:
    """mult x mean of the exponentially weighted deviation of log returns, per key."""
    d = ewm_std(df.withColumn("_lr", f.log_return(x)), f, "_lr", "_sd", n)
    return d.groupBy(*f.keys).agg((F.avg("_sd") * mult).alias("cusum_threshold"))


def cusum_events(df: DataFrame, f: Frame, mult: float = 2.0, n: int = 100, x: str = "close") -> DataFrame:
    df = df.join(cusum_thresholds(df, f, mult, n, x), list(f.keys)).withColumn("_lr", f.log_return(x))

    def kernel(pdf: pd.DataFrame) -> dict[str, object]:
        thr = float(pdf["cusum_threshold"].iloc[0]) if pdf["cusum_threshold"].notna().any() else 0.0
        return {"is_event": cusum_marks(pdf["_lr"].to_numpy(dtype=float), thr)}

    return scan(df, f, kernel, [("is_event", T.BooleanType())]).drop("_lr")


def event_density(df: DataFrame, keys: Sequence[str], flag: str = "is_event", low: float = 0.05, high: float = 0.30) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_if(flag).alias("n_events"), F.count(F.lit(1)).alias("n_bars"))
    return g.withColumn("density", div("n_events", "n_bars")).withColumn("in_range", F.col("density").between(low, high))


def vertical_barrier(f: Frame, n: int, ts: str = "ts") -> Column:
    """Time n rows ahead, or of the last row of the key."""
    return F.coalesce(f.lead(ts, n), F.max(ts).over(f.whole))


def triple_barrier(df: DataFrame, f: Frame, target: str, pt: float = 1.0, sl: float = 1.0, n: int = 5, side: Col | None = None, event: Col | None = None, x: str = "close", ts: str = "ts") -> DataFrame:
    """First touch of a volatility-scaled profit or stop level within n rows, else the vertical barrier.

    The forward path is a window list of n (time, price) pairs: bounded, and no self join.
    """
    s = F.lit(1) if side is None else col(side)
    price, vol = F.col(x), F.col(target)
    inf = float("inf")
    up_mult, dn_mult = F.when(s == 1, F.lit(pt)).otherwise(F.lit(sl)), F.when(s == 1, F.lit(sl)).otherwise(F.lit(pt))
    df = df.withColumns(
        {
            "_path": F.collect_list(F.struct(F.col(ts).alias("t"), price.alias("p"))).over(f.next_rows(n)),
            "_upper": F.when(up_mult > 0, price * (1 + up_mult * vol)).otherwise(F.lit(inf)),
            "_lower": F.when(dn_mult > 0, price * (1 - dn_mult * vol)).otherwise(F.lit(-inf)),
            "_side": s,
        }
    )
    if event is not None:
        df = df.filter(col(event))
    df = df.filter(F.col(target).isNotNull())
    touched = F.filter("_path", lambda q: (q["p"] >= F.col("_upper")) | (q["p"] <= F.col("_lower")))
    df = df.withColumn("_hit", F.get(touched, F.lit(0))).withColumn("_last", F.get("_path", F.size("_path") - 1))
    is_up = F.col("_hit.p") >= F.col("_upper")
    won = F.when(F.col("_side") == 1, is_up).otherwise(F.col("_hit.p") <= F.col("_lower"))
    end = F.coalesce(F.col("_hit"), F.col("_last"), F.struct(F.col(ts).alias("t"), price.alias("p")))
    df = df.withColumn("_end", end)
    return df.withColumns(
        {
            "t1": F.col("_end.t"),
            "ret": ln_ratio("_end.p", x),
            "bin": F.when(F.col("_hit").isNull(), 0).when(won, 1).otherwise(-1),
            "barrier_type": F.when(F.col("_hit").isNull(), "vb").when(won, "pt").otherwise("sl"),
        }
    ).drop("_path", "_upper", "_lower", "_side", "_hit", "_last", "_end")


def returns_at(labels: DataFrame, closes: DataFrame, keys: Sequence[str], ts: str = "ts", x: str = "close") -> DataFrame:
    """Log return from the label time to t1 by joining the closes."""
    p0 = closes.select(*keys, ts, F.col(x).alias("_p0"))
    p1 = closes.select(*keys, F.col(ts).alias("t1"), F.col(x).alias("_p1"))
    return labels.join(p0, [*keys, ts]).join(p1, [*keys, "t1"], "left").withColumn("ret", ln_ratio("_p1", "_p0")).drop("_p0", "_p1")


def trend_scan(df: DataFrame, f: Frame, longest: int = 20, shortest: int = 5, min_t: float = 0.0, x: str = "close", ts: str = "ts") -> DataFrame:
    """Forward window length with the largest |t| of the OLS slope of ln(price) on row position.

    Regression sums over the next L rows come from L+1 forward frames of one window; no row is copied.
    """
    df = df.withColumns({"_y": F.log(x), "_rn": f.rn()})
    stats = {}
    for length in range(shortest, longest + 1):
        w = f.w.rowsBetween(0, length - 1)
        stats[f"_w{length}"] = F.when(
            F.count("_y").over(w) == length,
            F.struct(F.covar_samp("_y", "_rn").over(w).alias("c"), F.var_samp("_y").over(w).alias("v"), F.max(ts).over(w).alias("t1")),
        )
    df = df.withColumns(stats)
    items = []
    for length in range(shortest, longest + 1):
        w = F.col(f"_w{length}")
        sxx = length * (length * length - 1) / 12.0
        slope = w["c"] * (length - 1) / sxx
        sse = F.greatest(w["v"] * (length - 1) - slope * slope * sxx, F.lit(0.0))
        err = F.sqrt(sse / (length - 2) / sxx)
        t = F.when(err > 1e-15, slope / err).otherwise(0.0)
        items.append(F.when(w.isNotNull(), F.struct(F.abs(t).alias("a"), F.lit(-length).alias("l"), t.alias("t"), w["t1"].alias("t1"))))
    df = df.withColumn("_best", F.array_max(F.array(*items))).filter(F.col("_best").isNotNull())
    return df.withColumns(
        {
            "t1": F.col("_best.t1"),
            "tvalue": F.col("_best.t"),
            "bin": F.when(F.col("_best.a") > min_t, F.signum("_best.t").cast("int")).otherwise(0),
        }
    ).drop("_y", "_rn", "_best", *stats)


def trend_weights(df: DataFrame, keys: Sequence[str], t: str = "tvalue") -> DataFrame:
    """|t| scaled to [0, 1] within the key."""
    g = df.groupBy(*keys).agg(F.min(F.abs(t)).alias("_lo"), F.max(F.abs(t)).alias("_hi"))
    return df.join(g, list(keys)).withColumn(
        "weight", F.coalesce(div(F.abs(t) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0))).drop("_lo", "_hi")


def meta_label(side: Col, outcome: Col) -> Column:
    """1 if the side made money (side x outcome > 0), else 0."""
    return (col(side) * col(outcome) > 0).cast("int")


def rows_at(features: DataFrame, events: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Feature rows at event times only."""
    return features.join(events.select(*keys, ts).distinct(), [*keys, ts], "left_semi")


