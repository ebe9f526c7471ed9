"""Moving averages: constant-rate ones as window sums, adaptive ones in one scan per key."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div
from tideline.functions.smoothing import decayed_by_key, ema_seeded, emas_seeded, ewm_columns, ewm_mean, ewm_span, span
from tideline.plans.scan import scan

EMA_PERIODS = (9, 10, 21, 50, 100, 200)


def add_emas(
    df: DataFrame, frame: Frame, cols: Sequence[str] = ("close",), periods: Sequence[int] = EMA_PERIODS, min_periods: int | None = None
) -> DataFrame:
    """``{col}_ema_{period}`` seeded with the mean of the first full window."""
    for c in cols:
        df = emas_seeded(df, frame, c, {f"{c}_ema_{p}": (span(p), min_periods or p) for p in periods})
    return df


def ema_by_horizon(df: DataFrame, frame: Frame, x: Col, out: str, days: int, min_periods: int | None = None) -> DataFrame:
    """EMA with the horizon given in days: alpha = 2 / (days + 1)."""
    return ema_seeded(df, frame, x, out, span(days), min_periods or days)


def periods_with_history(df: DataFrame, frame: Frame, periods: Sequence[int]) -> DataFrame:
    """(key, period) pairs with at least ``period`` observations."""
    n = df.groupBy(*frame.keys).agg(F.count(F.lit(1)).alias("n_obs"))
    return n.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods]))).filter("n_obs >= period")


def add_differences(df: DataFrame, frame: Frame, cols: Sequence[str], round_places: int | None = None) -> DataFrame:
    """First and second difference: ``{c}_d1``, ``{c}_d2``."""
    r = (lambda x: x) if round_places is None else (lambda x: F.round(x, round_places))
    df = df.withColumns({f"{c}_d1": r(frame.diff(c)) for c in cols})
    return df.withColumns({f"{c}_d2": r(frame.diff(f"{c}_d1")) for c in cols})


def scaled_differences(df: DataFrame, frame: Frame, ema: str, price: str, scale: str = "bps") -> DataFrame:
    """Differences relative to the price: in basis points or as a fraction."""
    k = 10_000.0 if scale == "bps" else 1.0
    df = add_differences(df, frame, [ema])
    return df.withColumns({f"{ema}_{d}_{scale}": div(F.col(f"{ema}_{d}"), price) * k for d in ("d1", "d2")})


def canonical_differences(df: DataFrame, keys: Sequence[str], value: str, roll: str, ts: str = "ts") -> DataFrame:
    """d1/d2 on every row (``*_roll``) and from canonical row to canonical row (NULL elsewhere)."""
    every, same = Frame(keys, (ts,)), Frame((*keys, roll), (ts,))
    df = df.withColumns(
        {f"{value}_d1_roll": every.diff(value), f"{value}_d1": F.when(~F.col(roll), same.diff(value))}
    )
    return df.withColumns(
        {
            f"{value}_d2_roll": every.diff(f"{value}_d1_roll"),
            f"{value}_d2": F.when(~F.col(roll), same.diff(f"{value}_d1")),
        }
    )


def roll_flag_by_count(frame: Frame, tf_days: int) -> Column:
    return frame.rn() % tf_days != 0


def roll_flag_by_calendar(df: DataFrame, canonical_ts: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """roll = the row's timestamp is not a canonical bar close."""
    marks = canonical_ts.select(*keys, ts).distinct().withColumn("_canon", F.lit(True))
    return df.join(marks, [*keys, ts], "left").withColumn("roll", F.col("_canon").isNull()).drop("_canon")


def daily_alpha(period: int, tf_days: float) -> float:
    return 1.0 - (1.0 - span(period)) ** (1.0 / tf_days)


def timeframe_emas(
    snapshots: DataFrame,
    tf_days: Mapping[str, float],
    periods: Sequence[int],
    keys: Sequence[str] = ("id", "tf"),
    ts: str = "ts",
    roll: str = "is_partial_end",
) -> DataFrame:
    """Two EMAs for each (timeframe, period) on the daily grid, with their differences, in long form and one pass.

    ``ema_bar``: recursion over canonical closes, seeded with the mean of the first ``period`` of them; an intra-bar row
    previews it as a * close + (1 - a) * last canonical value. ``ema``: the equivalent daily-rate recursion over every row from the
    first canonical ``ema_bar`` on. Periods are rows and rates are columns, so any number of timeframes and periods is one set
    of windows over one partitioning. ``*_d1``, ``*_d2`` step from canonical to canonical row, ``*_roll`` from row to row.
    """
    days = F.create_map(*[F.lit(x) for tf, n in tf_days.items() for x in (tf, float(n))])
    d = snapshots.filter(F.col("tf").isin(list(tf_days))).select(*keys, ts, "close", F.col(roll).alias("roll"), days[F.col("tf")].alias("_days"))
    d = d.withColumn("period", F.explode(F.array(*[F.lit(int(p)) for p in periods])))
    rate = F.lit(2.0) / (F.col("period") + 1.0)
    d = d.withColumns({"_bar": F.lit(1.0) - rate, "_day": F.pow(F.lit(1.0) - rate, F.lit(1.0) / F.col("_days"))})
    f = Frame((*keys, "period"), (ts,))
    closed = ~F.col("roll") & F.col("close").isNotNull()
    d = d.withColumns({"_nc": F.count_if(closed).over(f.cum), "_sc": F.sum(F.when(closed, F.col("close"))).over(f.cum)})
    d = d.withColumn("_pos", F.greatest(F.col("_nc") - F.col("period") + 1, F.lit(0)))
    value = F.when(F.col("_pos") == 1, F.col("_sc") / F.col("_nc")).when(F.col("_pos") > 1, F.col("close") * (1.0 - F.col("_bar")))
    d = d.withColumn("_x", F.when(closed, value))
    d = decayed_by_key(d, f, "_pos", "_x", "_bar", "_canon", 1.0 - span(min(periods)))
    preview = F.when(closed, F.col("_canon")).otherwise((1.0 - F.col("_bar")) * F.col("close") + F.col("_bar") * F.col("_canon"))
    d = d.withColumns({"ema_bar": preview, "_pos": F.count("_canon").over(f.cum)})
    d = d.withColumn("_x", F.when(F.col("_pos") == 1, F.col("_canon")).when(F.col("_pos") > 1, F.col("close") * (1.0 - F.col("_day"))))
    fastest = min((1.0 - span(min(periods))) ** (1.0 / n) for n in tf_days.values())
    d = decayed_by_key(d, f, "_pos", "_x", "_day", "ema", fastest)
    for v in ("ema", "ema_bar"):
        d = canonical_differences(d, (*keys, "period"), v, "roll", ts)
    out = [f"{v}{s}" for v in ("ema", "ema_bar") for s in ("", "_d1", "_d2", "_d1_roll", "_d2_roll")]
    return d.select(*keys, ts, "period", "close", "roll", *out)


# --- adaptive averages -----------------------------------------------------------------------------
def params_hash(params: Mapping[str, object]) -> str:
    return hashlib.md5(json.dumps(dict(params), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


# The canonical adaptive-average parameter sets.
KAMA_SETS = ((10, 2, 30), (5, 2, 15), (20, 2, 50))
LINEAR_PERIODS = (9, 10, 21, 50, 200)


def param_sets() -> list[tuple[str, dict[str, int]]]:
    sets: list[tuple[str, dict[str, int]]] = [
        ("KAMA", {"er_period": e, "fast_period": f, "slow_period": s}) for e, f, s in KAMA_SETS
    ]
    for kind in ("DEMA", "TEMA", "HMA"):
        sets += [(kind, {"period": p}) for p in LINEAR_PERIODS]
    return sets


def warmup_rows(kind: str, params: Mapping[str, int]) -> int:
    """Rows before the first value of an adaptive average."""
    if kind == "KAMA":
        return params["er_period"] - 1
    p = params["period"]
    return {"DEMA": 2 * p - 1, "TEMA": 3 * p - 1, "HMA": p + max(2, int(p**0.5)) - 2}[kind]


def param_table(spark: SparkSession) -> DataFrame:
    rows = [(k, params_hash(p), json.dumps(p, sort_keys=True), warmup_rows(k, p)) for k, p in param_sets()]
    return spark.createDataFrame(rows, "indicator string, params_hash string, params string, warmup int")


def efficiency_ratio(frame: Frame, x: Col, n: int, step: Col) -> Column:
    """|x - x[n-1 rows back]| over the sum of the n-1 absolute steps; ``step`` is |diff| as a column."""
    net = F.abs(col(x) - frame.lag(x, n - 1))
    path = F.when(F.count(col(step)).over(frame.last_rows(n - 1)) == n - 1, F.sum(col(step)).over(frame.last_rows(n - 1)))
    return F.when(path.isNotNull(), F.coalesce(F.try_divide(net, path), F.lit(0.0)))


def adaptive_mean(x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """y = y + alpha * (x - y), starting at x on the first row with an alpha."""
    out = np.full(len(x), np.nan)
    start = np.flatnonzero(~np.isnan(alpha) & ~np.isnan(x))
    if len(start) == 0:
        return out
    s = start[0]
    y = float(x[s])
    values = [y]
    for xv, av in zip(x[s + 1 :].tolist(), alpha[s + 1 :].tolist()):
        if xv == xv and av == av:
            y += av * (xv - y)
        values.append(y)
    out[s:] = values
    return out


def add_adaptive(df: DataFrame, frame: Frame, x: str, alphas: Mapping[str, str]) -> DataFrame:
    """Adaptive means ``out`` driven by alpha columns, all in one scan."""

    def kernel(pdf: pd.DataFrame) -> dict[str, object]:
        xs = pdf[x].to_numpy(dtype=float)
        return {o: adaptive_mean(xs, pdf[a].to_numpy(dtype=float)) for o, a in alphas.items()}

    return scan(df, frame, kernel, [(o, T.DoubleType()) for o in alphas])


def kama(df: DataFrame, frame: Frame, x: str = "close", sets: Sequence[tuple[int, int, int]] = KAMA_SETS) -> DataFrame:
    """Kaufman averages ``kama_{er}_{fast}_{slow}`` and their efficiency ratios ``er_{er}``."""
    df = df.withColumn("_step", F.abs(frame.diff(x)))
    df = df.withColumns({f"er_{n}": efficiency_ratio(frame, x, n, "_step") for n in {s[0] for s in sets}})
    alphas = {}
    for er, fast, slow in sets:
        lo, hi = span(slow), span(fast)
        name = f"kama_{er}_{fast}_{slow}"
        df = df.withColumn(f"_a_{name}", F.pow(F.col(f"er_{er}") * (hi - lo) + lo, F.lit(2.0)))
        alphas[name] = f"_a_{name}"
    return add_adaptive(df, frame, x, alphas).drop("_step", *alphas.values())


def dema_tema(df: DataFrame, frame: Frame, x: str, period: int | Sequence[int], kinds: Sequence[str] = ("dema", "tema")) -> DataFrame:
    """Double / triple EMAs of one or more periods with their warm-up rows masked, three passes in all."""
    periods = [period] if isinstance(period, int) else list(period)
    df = ewm_span(df, frame, x, {f"_e1_{p}": p for p in periods})
    df = ewm_columns(df, frame, x, {f"_e2_{p}": (f"_e1_{p}", span(p)) for p in periods})
    if "tema" in kinds:
        df = ewm_columns(df, frame, x, {f"_e3_{p}": (f"_e2_{p}", span(p)) for p in periods})
    df = df.withColumn("_rn", frame.rn())
    out: dict[str, Column] = {}
    for p in periods:
        e1, e2, e3 = (F.col(f"_e{i}_{p}") for i in (1, 2, 3))
        if "dema" in kinds:
            out[f"dema_{p}"] = F.when(F.col("_rn") > 2 * p - 1, 2 * e1 - e2)
        if "tema" in kinds:
            out[f"tema_{p}"] = F.when(F.col("_rn") > 3 * p - 1, 3 * e1 - 3 * e2 + e3)
    return df.withColumns(out).drop("_rn", *[f"_e{i}_{p}" for i in (1, 2, 3) for p in periods])


def hma(df: DataFrame, frame: Frame, x: str, period: int | Sequence[int]) -> DataFrame:
    """Hull average: WMA of (2 WMA(p/2) - WMA(p)) over sqrt(p) rows; all periods in two window stages."""
    periods = [period] if isinstance(period, int) else list(period)
    df = df.withColumn("_rn", frame.rn())
    df = df.withColumns({f"_h{p}": 2 * frame.wma(x, max(1, int(p / 2)), "_rn") - frame.wma(x, p, "_rn") for p in periods})
    df = df.withColumns({f"hma_{p}": frame.wma(f"_h{p}", max(2, int(p**0.5)), "_rn") for p in periods})
    return df.drop("_rn", *[f"_h{p}" for p in periods])


def adaptive_long(df: DataFrame, frame: Frame, x: str = "close", linear: Sequence[int] = LINEAR_PERIODS) -> DataFrame:
    """Every parameter set in long form: (key, ts, indicator, params_hash, value, d1, d2)."""
    df = kama(df, frame, x)
    df = hma(dema_tema(df, frame, x, linear), frame, x, linear)
    labels = []
    for kind, params in param_sets():
        if kind != "KAMA" and params["period"] not in linear:
            continue
        name = f"{kind.lower()}_" + "_".join(str(v) for v in params.values())
        labels.append(
            F.struct(F.lit(kind).alias("indicator"), F.lit(params_hash(params)).alias("params_hash"), F.col(name).alias("value"))
        )
    long = df.select(*frame.keys, *frame.order, F.explode(F.array(*labels)).alias("_v")).select(
        *frame.keys, *frame.order, "_v.*"
    )
    return add_differences(long, Frame((*frame.keys, "indicator", "params_hash"), frame.order), ["value"])


def adaptive_timeframes(df: DataFrame, frame: Frame, x: str = "close", roll: str | None = None, linear: Sequence[int] = LINEAR_PERIODS) -> DataFrame:
    """Every parameter set per (key, timeframe) in long form with its differences and returns, behind one exchange.

    ``frame`` has the timeframe among its keys. ``d1`` and ``d2`` step between rows of the same ``roll`` flag (finished
    bars, or open ones), ``d1_roll`` and ``d2_roll`` between neighbouring rows of any flag; without a flag they are equal.
    ``ret_arith`` and ``ret_log`` step like ``d1``. Window averages and their differences come first, the scan for KAMA
    last, with its differences inside, and rows are multiplied after that; a null flag counts as finished.
    """
    flag = F.lit(False) if roll is None else F.coalesce(F.col(roll), F.lit(False))
    df = df.select(*frame.keys, *frame.order, F.col(x).alias("_base"), flag.alias("roll"))
    same = Frame((*frame.keys, "roll"), frame.order)
    df = hma(dema_tema(df, frame, "_base", linear), frame, "_base", linear)
    names = [f"{kind}_{n}" for kind in ("dema", "tema", "hma") for n in linear]
    df = df.withColumns({f"{c}_d1_roll": frame.diff(c) for c in names})
    df = df.withColumns({f"{c}_d2_roll": frame.diff(f"{c}_d1_roll") for c in names})
    df = df.withColumns({f"{c}_d1": same.diff(c) for c in names} | {f"{c}_prev": same.lag(c) for c in names})
    df = df.withColumns({f"{c}_d2": same.diff(f"{c}_d1") for c in names})
    df = df.withColumn("_step", F.abs(frame.diff("_base")))
    df = df.withColumns({f"_er_{n}": efficiency_ratio(frame, "_base", n, "_step") for n in {s[0] for s in KAMA_SETS}})
    rates = {}
    for er, fast, slow in KAMA_SETS:
        rates[f"kama_{er}_{fast}_{slow}"] = F.pow(F.col(f"_er_{er}") * (span(fast) - span(slow)) + span(slow), F.lit(2.0))
    df = df.withColumns({f"_a_{n}": a for n, a in rates.items()})
    kamas = list(rates)
    steps = ("d1_roll", "d2_roll", "d1", "d2", "prev")

    def kernel(pdf: pd.DataFrame) -> dict[str, object]:
        xs, flags, out = pdf["_base"].to_numpy(dtype=float), pdf["roll"], {}
        for n in kamas:
            v = pd.Series(adaptive_mean(xs, pdf[f"_a_{n}"].to_numpy(dtype=float)), index=pdf.index)
            d1 = v.groupby(flags).diff()
            values = (v.diff(), v.diff().diff(), d1, d1.groupby(flags).diff(), v.groupby(flags).shift())
            out |= {n: v.to_numpy()} | {f"{n}_{k}": s.to_numpy() for k, s in zip(steps, values)}
        return out

    df = scan(df, frame, kernel, [(c, T.DoubleType()) for n in kamas for c in (n, *[f"{n}_{k}" for k in steps])])
    labels = []
    for kind, params in param_sets():
        if kind == "KAMA" or params["period"] in linear:
            name = f"{kind.lower()}_" + "_".join(str(v) for v in params.values())
            labels.append(F.struct(F.lit(kind).alias("indicator"), F.lit(params_hash(params)).alias("params_hash"), F.col(name).alias("value"), *[F.col(f"{name}_{k}").alias(k) for k in steps]))
    long = df.select(*frame.keys, *frame.order, "roll", F.explode(F.array(*labels)).alias("_v")).select(*frame.keys, *frame.order, "roll", "_v.*")
    return long.withColumns({"ret_arith": F.try_divide("value", "prev") - 1, "ret_log": F.when((F.col("value") > 0) & (F.col("prev") > 0), F.log(F.col("value") / F.col("prev")))}).drop("prev")


def vidya(df: DataFrame, frame: Frame, x: str = "close", cmo: int = 9, period: int = 9, out: str | None = None) -> DataFrame:
    """Average whose rate is |Chande momentum| of the last ``cmo`` steps times 2/(period+1)."""
    step = frame.diff(x)
    df = df.withColumns({"_up": F.when(step > 0, step).otherwise(F.when(step.isNotNull(), 0.0)),
                         "_dn": F.when(step < 0, -step).otherwise(F.when(step.isNotNull(), 0.0))})
    up, dn = frame.sum("_up", cmo), frame.sum("_dn", cmo)
    rate = F.when(up.isNotNull(), F.abs(F.coalesce(F.try_divide(up - dn, up + dn), F.lit(0.0))) * span(period))
    df = df.withColumn("_rate", rate)
    return add_adaptive(df, frame, x, {out or f"vidya_{period}": "_rate"}).drop("_up", "_dn", "_rate")


def frama(df: DataFrame, frame: Frame, x: str = "close", period: int = 16, out: str | None = None) -> DataFrame:
    """Fractal average: rate exp(-4.6 (D - 1)) clipped to [0.01, 1], D from the ranges of the halves."""
    p = period + period % 2
    half = p // 2
    w = frame.w
    first, second, whole = w.rowsBetween(1 - p, -half), w.rowsBetween(1 - half, 0), w.rowsBetween(1 - p, 0)
    rng = lambda win, n: (F.max(x).over(win) - F.min(x).over(win)) / n
    df = df.withColumns({"_n12": rng(first, half) + rng(second, half), "_n3": rng(whole, p), "_c": F.count(x).over(whole)})
    d = F.when((F.col("_n12") <= 0) | (F.col("_n3") <= 0), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.log(F.lit(2.0)), F.log("_n12") - F.log("_n3")), F.lit(1.0))
    )
    rate = F.least(F.greatest(F.exp(-4.6 * (d - 1.0)), F.lit(0.01)), F.lit(1.0))
    df = df.withColumn("_rate", F.when(F.col("_c") >= p, rate))
    return add_adaptive(df, frame, x, {out or f"frama_{p}": "_rate"}).drop("_n12", "_n3", "_c", "_rate")
