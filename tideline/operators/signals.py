"""Entry/exit rules, sizing, derivatives features, composites and position records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, bool0, col, div, sign
from tideline.functions.smoothing import ewm_span


# --- rules -----------------------------------------------------------------------------------------
def cross_up(f: Frame, a: Col, b: Col) -> Column:
    return bool0((col(a) > col(b)) & (f.lag(a) <= f.lag(b)))


def cross_down(f: Frame, a: Col, b: Col) -> Column:
    return bool0((col(a) < col(b)) & (f.lag(a) >= f.lag(b)))


def rsi_ok(rsi: Col, long_min: float | None = None, short_max: float | None = None) -> Column:
    return bool0(col(rsi) >= long_min) if long_min is not None else bool0(col(rsi) <= short_max)


def volatile_enough(atr: Col, close: Col, min_pct: float) -> Column:
    return bool0(div(atr, close) >= min_pct)


def rows_since(f: Frame, flag: Col, rn: Col) -> Column:
    """Rows since the last true flag; NULL before the first."""
    return col(rn) - F.last(F.when(col(flag), col(rn)), ignorenulls=True).over(f.cum)


def position_from(f: Frame, entry: Col, exit_: Col) -> Column:
    """1 from an entry until an exit (an exit on the entry row wins), else 0."""
    event = F.when(col(exit_), F.lit(0)).when(col(entry), F.lit(1))
    return F.coalesce(F.last(event, ignorenulls=True).over(f.cum), F.lit(0))


def crossover_signals(df: DataFrame, f: Frame, fast: str, slow: str, rsi: str | None = None, rsi_min: float = 45, atr: str | None = None, min_atr_pct: float = 0.003, shorts: bool = False, rsi_max: float = 55, cooldown: int = 0, close: str = "close") -> DataFrame:
    """EMA cross with optional RSI, volatility and cooldown gates; signal, position and inverse-vol size."""
    df = df.withColumns({"_cu": cross_up(f, fast, slow), "_cd": cross_down(f, fast, slow)})
    gate_l = gate_s = F.lit(True)
    if rsi is not None:
        gate_l, gate_s = gate_l & rsi_ok(rsi, rsi_min), gate_s & rsi_ok(rsi, None, rsi_max)
    if atr is not None:
        ok = volatile_enough(atr, close, min_atr_pct)
        gate_l, gate_s = gate_l & ok, gate_s & ok
    if cooldown > 0:
        exits = F.col("_cd") | F.col("_cu") if shorts else F.col("_cd")
        free = F.max(exits.cast("int")).over(f.last_rows(cooldown + 1)) == 0
        gate_l, gate_s = gate_l & free, gate_s & free
    cols = {"entry_long": F.col("_cu") & gate_l, "exit_long": F.col("_cd")}
    if shorts:
        cols |= {"entry_short": F.col("_cd") & gate_s, "exit_short": F.col("_cu")}
    df = df.withColumns(cols)
    event = F.when(F.col("entry_long"), 1)
    if shorts:
        event = F.when(F.col("entry_long"), 1).when(F.col("entry_short"), -1).when(F.col("exit_long") | F.col("exit_short"), 0)
    else:
        event = event.when(F.col("exit_long"), 0)
    df = df.withColumns({"signal": F.coalesce(event, F.lit(0)), "position": F.coalesce(F.last(event, ignorenulls=True).over(f.cum), F.lit(0))})
    if atr is not None:
        raw = div(1.0 * F.lit(1.0), F.greatest(div(atr, close), F.lit(1e-12)))
        df = df.withColumn("_raw", raw)
        cap = df.groupBy(*f.keys).agg(F.percentile("_raw", 0.95).alias("_cap"))
        df = df.join(cap, list(f.keys)).withColumn("size", F.coalesce(F.least(div("_raw", "_cap"), F.lit(1.0)), F.lit(0.0))).drop("_raw", "_cap")
    return df.drop("_cu", "_cd")


def macd_signals(df: DataFrame, f: Frame, fast: int = 12, slow: int = 26, signal: int = 9, direction: str = "long") -> DataFrame:
    from tideline.operators.indicators import macd

    df = macd(df, f, fast, slow, signal)
    line, sig = f"macd_{fast}_{slow}", f"macd_signal_{fast}_{slow}_{signal}"
    up, dn = cross_up(f, line, sig), cross_down(f, line, sig)
    return df.withColumns({"entry": up if direction == "long" else dn, "exit": dn if direction == "long" else up})


def rsi_reversion(df: DataFrame, f: Frame, rsi: str = "rsi_14", lower: float = 30, upper: float = 70, confirm: bool = True, shorts: bool = False) -> DataFrame:
    below, above = bool0(F.col(rsi) <= lower), bool0(F.col(rsi) >= upper)
    df = df.withColumns({"_b": below, "_a": above})
    pb, pa = bool0(f.lag("_b")), bool0(f.lag("_a"))
    falling, rising = bool0(f.lag(rsi) > F.col(rsi)), bool0(f.lag(rsi) < F.col(rsi))
    entry = ~F.col("_b") & pb
    leave = (F.col("_a") & ~pa) | falling if confirm else F.col("_a")
    if shorts:
        entry = entry | (~F.col("_a") & pa)
        leave = leave | ((F.col("_b") & ~pb) | rising if confirm else F.col("_b"))
    return df.withColumns({"entry": entry, "exit": leave}).drop("_b", "_a")


def breakout(df: DataFrame, f: Frame, n: int = 20, atr: str | None = None, confirm_close: bool = True, trail_mult: float = 2.0, exit_on: str = "channel") -> DataFrame:
    """Break of the prior n-row channel; exit by channel cross-back or a stop trailing from each entry."""
    df = df.withColumns({"_hi": f.max("high", n), "_lo": f.min("low", n)})
    df = df.withColumns({"channel_high": f.lag("_hi"), "channel_low": f.lag("_lo")})
    up, dn = ("close", "close") if confirm_close else ("high", "low")
    df = df.withColumns({"entry": bool0(F.col(up) > F.col("channel_high")), "exit_channel": bool0(F.col(dn) < F.col("channel_low"))})
    if exit_on == "channel" or atr is None:
        return df.withColumn("exit", F.col("exit_channel")).drop("_hi", "_lo")
    df = df.withColumn("_trade", F.sum(F.col("entry").cast("int")).over(f.cum))
    inside = Frame((*f.keys, "_trade"), f.order)
    line = F.max(F.col("close") - trail_mult * F.col(atr)).over(inside.before)
    stop = (F.col("_trade") > 0) & bool0(F.col("close") < line)
    return df.withColumn("exit", stop).drop("_hi", "_lo", "_trade")


def breakout_type(close: Col, high_channel: Col, atr: Col, mean_atr: Col, expansion: float = 1.5) -> Column:
    broke, wide = bool0(col(close) > col(high_channel)), bool0(col(atr) > expansion * col(mean_atr))
    return F.when(broke & wide, "both").when(broke, "channel_break").when(wide, "atr_expansion")


def threshold_signals(df: DataFrame, f: Frame, feature: str, enter: float = 0.0, leave: float = 0.0, direction: str = "long", holding: int = 0) -> DataFrame:
    x = F.coalesce(F.col(feature), F.lit(0.0))
    e, q = (x > enter, x < leave) if direction == "long" else (x < enter, x > leave)
    df = df.withColumns({"entry": e, "exit": q})
    return holding_exit(df, f, "entry", holding) if holding > 0 else df


def holding_exit(df: DataFrame, f: Frame, entry: str, bars: int) -> DataFrame:
    df = df.withColumn("_rn", f.rn())
    df = df.withColumn("bars_since_entry", rows_since(f, entry, "_rn"))
    return df.withColumn("exit", F.col("exit") | bool0(F.col("bars_since_entry") >= bars)).drop("_rn")


def ama_momentum(df: DataFrame, f: Frame, cols: Mapping[str, float], holding: int = 7, threshold: float = 0.0, n: int = 20) -> DataFrame:
    """z-score of the weighted composite against +-threshold with a holding limit."""
    total = sum(abs(w) for w in cols.values())
    df = df.withColumn("_c", sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in cols.items()), F.lit(0.0)))
    df = df.withColumn("z", f.zscore("_c", n, 2)).drop("_c")
    df = df.withColumns({"entry": bool0(F.col("z") > threshold), "exit": bool0(F.col("z") < -threshold)})
    return holding_exit(df, f, "entry", holding)


def ama_reversion(df: DataFrame, f: Frame, ama: str, n: int = 20, enter: float = -1.5, leave: float = 0.0, holding: int = 10, price: str = "close") -> DataFrame:
    df = df.withColumn("_s", F.col(price) - F.col(ama)).withColumn("z", f.zscore("_s", n, 2)).drop("_s")
    df = df.withColumns({"entry": bool0(F.col("z") < enter), "exit": bool0(F.col("z") > leave)})
    return holding_exit(df, f, "entry", holding)


def ama_regime(df: DataFrame, f: Frame, ama: str, adx: str, floor: float = 20.0, holding: int = 7) -> DataFrame:
    move, trending = f.diff(ama), bool0(F.col(adx) > floor)
    df = df.withColumns({"entry": bool0(move > 0) & trending, "exit": bool0(move < 0) | ~trending})
    return holding_exit(df, f, "entry", holding)


# --- registry --------------------------------------------------------------------------------------
def _spans(params: Mapping[str, object], *names: str) -> dict[str, int]:
    """Columns ``ema_n`` named by parameters."""
    cols = [str(params[n]) for n in names if params.get(n)]
    return {c: int(c.rsplit("_", 1)[1]) for c in cols if c.startswith("ema_")}


def ensure_columns(name: str, df: DataFrame, f: Frame, params: Mapping[str, object] | None = None) -> DataFrame:
    """Add what a named strategy needs with these parameters and does not find.

    All missing EMA spans come in one pass. Unknown names, and strategies whose inputs are loaded features (AMA columns but
    for KAMA, cross-timeframe features), change nothing.
    """
    from tideline.operators import averages as A
    from tideline.operators import indicators as I

    params = params or {}
    missing = lambda c: c not in df.columns
    if name == "ema_trend":
        spans = {c: n for c, n in ({"ema_21": 21, "ema_50": 50} | _spans(params, "fast", "slow")).items() if missing(c)}
        return ewm_span(df, f, "close", spans) if spans else df
    if name == "rsi_mean_revert":
        rsi, atr = str(params.get("rsi", "rsi_14")), str(params.get("atr", "atr_14"))
        spans = {c: n for c, n in _spans(params, "trend_fast", "trend_slow").items() if missing(c)}
        df = ewm_span(df, f, "close", spans) if spans else df
        df = I.rsi(df, f, n=int(rsi.rsplit("_", 1)[1])) if missing(rsi) else df
        return I.atr(df, f, n=int(atr.rsplit("_", 1)[1])) if missing(atr) else df
    if name in ("breakout_atr", "ama_regime_conditional"):
        atr = str(params.get("atr", "atr_14"))
        return I.atr(df, f, n=int(atr.rsplit("_", 1)[1])) if missing(atr) else df
    if name == "ama_mean_reversion":
        return A.kama(df, f, sets=((10, 2, 30),)) if missing(str(params.get("ama", "kama_10_2_30"))) else df
    return df


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "ema_trend": lambda df, f, fast="ema_21", slow="ema_50", **k: crossover_signals(df, f, fast, slow, **k),
    "rsi_mean_revert": lambda df, f, **k: rsi_reversion(df, f, **k),
    "macd_crossover": macd_signals,
    "breakout_atr": breakout,
    "ama_momentum": ama_momentum,
    "ama_mean_reversion": ama_reversion,
    "ama_regime_conditional": ama_regime,
    "ctf_threshold": threshold_signals,
}


def default_grid(name: str) -> list[dict[str, object]]:
    """Default parameter sets of a strategy for a coarse scan (fixed values, by rule)."""
    if name == "ema_trend":
        return [{"fast": f"ema_{f}", "slow": f"ema_{s}"} for f in range(5, 61, 5) for s in (80, 100, 120, 150, 200) if s >= f + 5]
    if name == "rsi_mean_revert":
        sized = {"atr": "atr_14", "risk_pct": 0.5, "atr_mult_stop": 1.5, "max_leverage": 1.0}
        trend = lambda on: {"trend_fast": "ema_17" if on else None, "trend_slow": "ema_77" if on else None, "use_trend": on}
        return [{"rsi": f"rsi_{n}", "lower": lo, "upper": hi} | trend(on) | sized for n in (7, 14, 21) for lo, hi in ((25, 55), (30, 60), (35, 65)) for on in (True, False)]
    if name == "macd_crossover":
        return [{"fast": f, "slow": s, "signal": g} for f, s, g in ((8, 17, 9), (12, 26, 9), (19, 39, 9))]
    if name == "breakout_atr":
        return []
    if name == "ama_momentum":
        return [{"holding": h, "threshold": t} for h in (5, 7, 10) for t in (0.0, 0.5)]
    if name == "ama_mean_reversion":
        return [{"ama": c, "enter": z} for c in ("KAMA_de1106d5_ama", "KAMA_987fc105_ama") for z in (-1.0, -1.5, -2.0)]
    if name == "ama_regime_conditional":
        return [{"floor": a, "holding": h} for a in (15.0, 20.0, 25.0) for h in (5, 7, 10)]
    if name == "ctf_threshold":
        return [{"feature": c, "enter": t, "leave": -t, "direction": d, "holding": 7}
                for c in ("ret_arith_365d_divergence", "vol_ratio_30d", "ema_cross_score") for t in (-0.5, 0.0, 0.5) for d in ("long", "short")]
    raise KeyError(f"no default grid for {name!r}")


def ema_grid_positions(df: DataFrame, f: Frame, grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """Positions of every (fast, slow) set of a grid: all spans in one pass, the sets as rows, one window for all crossings.

    Rows: keys, order, close, fast, slow, position (1 from a cross above until a cross below).
    """
    spans = {k: v for p in grid for k, v in _spans(p, "fast", "slow").items()}
    df = ewm_span(df, f, "close", spans)
    sets = F.array(*[F.struct(F.lit(p["fast"]).alias("fast"), F.lit(p["slow"]).alias("slow"), F.col(str(p["fast"])).alias("_f"), F.col(str(p["slow"])).alias("_s")) for p in grid])
    long = df.select(*f.keys, *f.order, "close", F.explode(sets).alias("_i")).select(*f.keys, *f.order, "close", "_i.*")
    g = Frame((*f.keys, "fast", "slow"), f.order)
    long = long.withColumns({"_up": cross_up(g, "_f", "_s"), "_dn": cross_down(g, "_f", "_s")})
    return long.withColumn("position", position_from(g, "_up", "_dn")).drop("_f", "_s", "_up", "_dn")


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """All combinations as rows (a handful of literals per parameter)."""
    df = spark.range(1).select()
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def random_params(spark: SparkSession, grid: Mapping[str, Sequence[float]], n: int, seed: int = 0) -> DataFrame:
    return param_grid(spark, grid).orderBy(F.rand(seed)).limit(n)


# --- sizing ----------------------------------------------------------------------------------------
def risk_size(price: Col, atr: Col, risk: float = 0.005, mult: float = 1.5) -> Column:
    return F.coalesce(div(risk * col(price), mult * col(atr)), F.lit(0.0))


def inverse_vol_size(vol: Col, target: float = 0.5, low: float = 0.0, high: float = 1.0, eps: float = 1e-12) -> Column:
    v = F.nullif(F.abs(col(vol)), F.lit(0.0))
    return F.least(F.greatest(F.coalesce(F.lit(target) / (v + eps), F.lit(0.0)), F.lit(low)), F.lit(high))


def vol_units(close: Col, atr: Col, cash: float, budget: float = 0.01, cap: float = 0.3) -> Column:
    share = F.least(F.try_divide(F.lit(budget), div(atr, close)), F.lit(cap))
    return share * cash / col(close)


def adaptive_thresholds(df: DataFrame, f: Frame, x: str, n: int = 100, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    return df.withColumns({f"{x}_lower": f.quantile(x, lo, n, n // 2), f"{x}_upper": f.quantile(x, hi, n, n // 2)})


# --- position records ------------------------------------------------------------------------------
def position_records(df: DataFrame, f: Frame, entry: str = "entry", exit_: str = "exit", price: str = "close", snapshot: Sequence[str] = ()) -> DataFrame:
    """Entries paired with the next exits, oldest open first, with pnl % and a JSON feature snapshot.

    The n-th exit that has an open position closes the n-th entry: with ``level`` = entries minus exits
    reflected at zero, an exit is effective while the level before it is positive, which a running
    minimum gives without a loop.
    """
    ts = f.order[0]
    step = F.col(entry).cast("int") - F.col(exit_).cast("int")
    df = df.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(f.cum))
    floor = F.least(F.min("_sum").over(f.cum), F.lit(0))
    df = df.withColumn("_lost", -floor)
    df = df.withColumns({"_ein": F.sum(F.col(entry).cast("int")).over(f.cum), "_used": F.sum(F.col(exit_).cast("int")).over(f.cum) - F.col("_lost")})
    f_lag = F.coalesce(f.lag("_used"), F.lit(0))
    snap = F.to_json(F.struct(*[F.col(c) for c in snapshot])) if snapshot else F.lit("{}")
    opens = df.filter(entry).select(*f.keys, F.col("_ein").alias("position_no"), F.col(ts).alias("entry_ts"), F.col(price).alias("entry_price"), snap.alias("snapshot"))
    closes = df.withColumn("_prev", f_lag).filter(F.col(exit_) & (F.col("_used") > F.col("_prev"))).select(
        *f.keys, F.col("_used").alias("position_no"), F.col(ts).alias("exit_ts"), F.col(price).alias("exit_price"))
    return opens.join(closes, [*f.keys, "position_no"], "left").withColumns(
        {"pnl_pct": (div("exit_price", "entry_price") - 1) * 100.0, "state": F.when(F.col("exit_ts").isNull(), "open").otherwise("closed")})


def feature_hash(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str = "ts") -> DataFrame:
    """SHA-256 over the ordered rows of a key: row hashes are collected, not rows."""
    row = F.sha2(F.concat_ws("|", F.col(order).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    per_month = df.groupBy(*keys, F.trunc(order, "month").alias("_m")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("h")))), lambda s: s["h"]), ""), 256).alias("_h"))
    return per_month.groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", "_h"))), lambda s: s["_h"]), ""), 256).alias("feature_hash"))


def stale_hashes(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    j = stored.select(*keys, F.col("feature_hash").alias("stored")).join(current, list(keys), "full")
    return j.withColumn("is_current", F.coalesce(F.col("stored") == F.col("feature_hash"), F.lit(False))).select(*keys, "is_current")


def count_anomalies(signals: DataFrame, by: Sequence[str], ts: str = "ts", z: float = 3.0) -> DataFrame:
    """Newest day's signal count against the mean and deviation of the earlier days."""
    d = signals.groupBy(*by, F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = d.groupBy(*by).agg(F.max("day").alias("last_day"))
    g = d.join(last, list(by)).groupBy(*by).agg(
        F.max("last_day").alias("last_day"), F.sum(F.when(F.col("day") == F.col("last_day"), F.col("n"))).alias("today"),
        F.avg(F.when(F.col("day") < F.col("last_day"), F.col("n"))).alias("mean"), F.stddev_samp(F.when(F.col("day") < F.col("last_day"), F.col("n"))).alias("std"))
    return g.withColumn("z", div(F.col("today") - F.col("mean"), "std")).withColumn("is_anomaly", F.coalesce(F.abs("z") > z, F.lit(False)))


def crowding(signals: DataFrame, side: str = "side", ts: str = "ts", limit: float = 0.8) -> DataFrame:
    g = signals.groupBy(F.col(ts).cast("date").alias("day")).agg(F.avg((F.col(side) > 0).cast("double")).alias("long_share"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("is_crowded", F.greatest(F.col("long_share"), 1 - F.col("long_share")) >= limit)


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float = 1e-8) -> DataFrame:
    j = a.select(*keys, *[F.col(v).alias(f"{v}_1") for v in values], F.lit(1).alias("_a")).join(
        b.select(*keys, *[F.col(v).alias(f"{v}_2") for v in values], F.lit(1).alias("_b")), list(keys), "full")
    gap = F.greatest(*[F.abs(F.col(f"{v}_1") - F.col(f"{v}_2")) for v in values], F.lit(0.0))
    return j.withColumns({"max_gap": gap, "result": F.when(F.col("_a").isNull(), "only_2").when(F.col("_b").isNull(), "only_1").when(gap > tol, "differs").otherwise("same")}).select(*keys, "max_gap", "result")


def blend_positions(tables: Sequence[tuple[DataFrame, float]], keys: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Sign of the weighted sum of positions; a table without the row counts as flat."""
    out: DataFrame | None = None
    for df, w in tables:
        part = df.select(*keys, (F.col("position") * w).alias("v"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    g = out.groupBy(*keys).agg(F.sum("v").alias("vote"))
    return g.withColumn("position", F.when(F.col("vote") > threshold, 1).when(F.col("vote") < -threshold, -1).otherwise(0))


# --- derivatives features --------------------------------------------------------------------------
def oi_features(df: DataFrame, f: Frame, n: int = 20, mom: int = 5) -> DataFrame:
    """Open-interest momentum, price divergence, funding z and its momentum, volume-OI regime."""
    df = df.withColumns({"oi_mom": f.pct("oi", mom), "px_mom": f.pct("close", mom), "funding_z": f.zscore("funding", n), "_do": f.diff("oi"), "_dv": f.diff("volume"), "_dp": f.diff("close")})
    up, dn = F.col("_do") > 0, F.col("_do") <= 0
    vol, price = F.col("_dv") > 0, F.col("_dp") > 0
    regime = (F.when(up & vol & price, 1).when(up & vol & ~price, 2).when(dn & vol & price, 3).when(dn & vol & ~price, 4).when(up & ~vol, 5)
              .when(dn & ~vol, 6))
    df = df.withColumns({"_gap": F.col("oi_mom") - F.col("px_mom"), "funding_mom": f.diff("funding_z", mom), "vol_oi_regime": regime})
    df = df.withColumn("oi_price_div", f.zscore("_gap", n))
    df = df.withColumn("liquidation_pressure", 0.4 * F.abs("funding_z") + 0.3 * F.abs("oi_mom") + 0.3 * F.abs("oi_price_div"))
    return df.drop("_do", "_dv", "_dp", "_gap", "px_mom")


def oi_force(df: DataFrame, f: Frame, n: int = 13) -> DataFrame:
    df = df.withColumn("_f", f.diff("close") * F.col("volume") * div("oi", F.avg("oi").over(f.last_rows(n))))
    return ewm_span(df, f, "_f", {"oi_force": n}).drop("_f")


def oi_concentration(df: DataFrame, f: Frame, n: int = 20, ts: str = "ts") -> DataFrame:
    tot = df.groupBy(ts).agg(F.sum("oi").alias("_t"))
    df = df.join(tot, ts).withColumn("oi_share", div("oi", "_t")).drop("_t")
    return df.withColumn("oi_share_z", f.zscore("oi_share", n))


# --- composites ------------------------------------------------------------------------------------
def er_regime(df: DataFrame, f: Frame, er: str, kama: str, n: int = 60, need: int = 20) -> DataFrame:
    """Percent rank of the efficiency ratio in the window times the side of price against the average."""
    rank = f.window_rank(er, n, need)
    size = F.count(er).over(f.last_rows(n))
    return df.withColumn("er_regime", div(rank, size) * sign(F.col("close") - F.col(kama)))


def oi_divergence_agreement(df: DataFrame, f: Frame, agreement: str, n: int = 60, mom: int = 5) -> DataFrame:
    df = df.withColumns({"_o": f.pct("oi", mom), "_p": f.pct("close", mom)})
    return df.withColumn("oi_div_agreement", (f.zscore("_o", n) - f.zscore("_p", n)) * F.coalesce(F.col(agreement), F.lit(1.0))).drop("_o", "_p")


def funding_adjusted_momentum(df: DataFrame, f: Frame, n: int = 60, mom: int = 20) -> DataFrame:
    df = df.withColumns({"_m": f.pct("close", mom), "_s": f.sum("funding", mom)})
    return df.withColumn("funding_adj_mom", f.zscore("_m", n) - f.zscore("_s", n)).drop("_m", "_s")


def leader_composite(df: DataFrame, leaders: DataFrame, f: Frame, x: str, horizon: int, ts: str = "ts") -> DataFrame:
    """sum(ic x leader feature ``horizon`` rows ago) / sum |ic| per follower and time."""
    lagged = df.select(F.col("id").alias("leader"), ts, f.lag(x, horizon).alias("_v")).filter("_v IS NOT NULL")
    j = leaders.join(lagged, "leader")
    return j.groupBy(F.col("follower").alias("id"), ts).agg(div(F.sum(F.col("ic") * F.col("_v")), F.sum(F.abs("ic"))).alias("lead_lag_composite"))


def tf_alignment(ctf: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return ctf.groupBy(*keys, ts).agg((F.avg("agreement") - 0.5).alias("tf_alignment"))


def gated_trend(df: DataFrame, f: Frame, kama: str, atr: str, n: int = 20) -> DataFrame:
    vol = div("volume", f.mean("volume", n))
    return df.withColumn("gated_trend", div(F.col("close") - F.col(kama), atr) * (0.5 + 0.5 * F.tanh(vol - 1)))


# --- stop ladders ----------------------------------------------------------------------------------
def exit_schedule(positions: DataFrame, stops: Sequence[tuple[float, float]], targets: Sequence[tuple[float, float]]) -> DataFrame:
    """Tiered stop / target levels: (distance, share) lists become one row per tier."""
    side = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    tiers = [F.struct(F.lit("sl").alias("kind"), F.lit(i + 1).alias("tier"), (F.col("entry_price") * (1 - side * d)).alias("level"), F.lit(s).alias("share")) for i, (d, s) in enumerate(stops)]
    tiers += [F.struct(F.lit("tp").alias("kind"), F.lit(i + 1).alias("tier"), (F.col("entry_price") * (1 + side * d)).alias("level"), F.lit(s).alias("share")) for i, (d, s) in enumerate(targets)]
    return positions.withColumn("_t", F.explode(F.array(*tiers))).select(*positions.columns, "_t.*")


def triggered_tiers(schedule: DataFrame, prices: DataFrame, by: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    j = schedule.join(prices.select(*by, F.col("price").alias("_px")), list(by))
    long = F.col("side") == "long"
    below, above = F.col("_px") <= F.col("level"), F.col("_px") >= F.col("level")
    hit = F.when(F.col("kind") == "sl", F.when(long, below).otherwise(above)).otherwise(F.when(long, above).otherwise(below))
    out = j.filter(hit).drop("_px")
    return out if done is None else out.join(done, [*by, "kind", "tier"], "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


