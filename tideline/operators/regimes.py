"""Regime labels, hysteresis, policies, flips and transition statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, bool0, col, div, run_ids
from tideline.functions.smoothing import ewm_span
from tideline.plans.scan import scan


def trend_label(f: Frame, price: str, fast: str, mid: str, slow: str, confirm: int = 0, adx: str | None = None, adx_floor: float = 0.0) -> tuple[dict[str, Column], Column]:
    """(helper columns to add first, label). Up / Down need every one of the last ``confirm`` rows."""
    up = bool0((F.col(price) > F.col(slow)) & (F.col(fast) > F.col(mid)))
    dn = bool0((F.col(price) < F.col(slow)) & (F.col(fast) < F.col(mid)))
    helpers = {"_up": up.cast("int"), "_dn": dn.cast("int")}
    n = max(confirm, 1)
    held = lambda c: bool0(f.guarded(F.min(c), c, n) == 1)
    strong = F.lit(True) if adx is None or adx_floor <= 0 else ~bool0(F.col(adx) <= adx_floor)
    return helpers, F.when(held("_up") & strong, "Up").when(held("_dn") & strong, "Down").otherwise("Sideways")


def with_trend(df: DataFrame, f: Frame, out: str = "trend", **kw) -> DataFrame:
    helpers, label = trend_label(f, **kw)
    return df.withColumns(helpers).withColumn(out, label).drop("_up", "_dn")


def with_vol_bucket(df: DataFrame, f: Frame, atr: str | None = None, price: str = "close", n: int = 100, mode: str = "full", low: float = 0.015, high: float = 0.04, out: str = "vol") -> DataFrame:
    """Percentile of ATR% (or of the 14-row mean absolute move) inside the window; NULL before it fills."""
    if atr is not None:
        df = df.withColumn("_a", div(atr, price))
    else:
        df = df.withColumn("_m", F.abs(f.pct(price))).withColumn("_a", f.mean("_m", 14)).drop("_m")
    lite = F.when(F.col("_a") < low, "Low").when(F.col("_a") > high, "High").when(F.col("_a").isNotNull(), "Normal")
    if mode != "full":
        return df.withColumn(out, lite).drop("_a")
    # the rank is divided by the window length, which is shorter at the start of a key
    df = df.withColumn("_p", 100.0 * f.window_rank("_a", n, max(20, n // 3)) / F.least(f.rn(), F.lit(n)))
    full = F.when(F.col("_p") < 33, "Low").when(F.col("_p") < 67, "Normal").when(F.col("_p").isNotNull(), "High")
    enough = F.count(F.lit(1)).over(f.whole) >= n
    return df.withColumn(out, F.when(enough, full).otherwise(lite)).drop("_a", "_p")


def with_liquidity_bucket(df: DataFrame, f: Frame, spread: str, slip: str, n: int = 60, out: str = "liq") -> DataFrame:
    need = max(10, n // 3)
    df = df.withColumns({"_ms": f.quantile(spread, 0.5, n, need), "_ml": f.quantile(slip, 0.5, n, need)})
    s, l, ms, ml = F.col(spread), F.col(slip), F.col("_ms"), F.col("_ml")
    easy = bool0((s < 0.8 * ms) & (l < 0.8 * ml))
    stressed = bool0(s > 2.0 * ms) | bool0(l > 2.0 * ml)
    return df.withColumn(out, F.when(easy, "Easy").when(stressed, "Stressed").otherwise("Normal")).drop("_ms", "_ml")


def regime_key(trend: Col, vol: Col, liq: Col) -> Column:
    return F.concat_ws("-", col(trend), F.coalesce(col(vol), F.lit("")), col(liq))


# Fixed values per layer: (fast, mid, slow) EMA spans, confirm rows, volatility window.
LAYERS: dict[str, tuple[tuple[int, int, int], int, int]] = {
    "L0": ((12, 24, 48), 2, 60),
    "L1": ((20, 50, 200), 2, 100),
    "L2": ((20, 50, 100), 2, 250),
    "L3": ((34, 55, 89), 1, 300),
}


def layer_labels(df: DataFrame, f: Frame, layer: str, mode: str = "full", price: str = "close") -> DataFrame:
    """trend-vol-liq key of one layer on its own bars."""
    spans, confirm, n = LAYERS[layer]
    names = {f"_e{s}": s for s in spans}
    fast, mid, slow = names
    df = ewm_span(df, f, price, names)
    df = with_trend(df, f, "_t", price=price, fast=fast, mid=mid, slow=slow, confirm=confirm)
    df = with_vol_bucket(df, f, price=price, n=n if mode == "full" else max(30, n // 2), mode="lite" if layer == "L3" else mode, out="_v")
    return df.withColumn(layer, regime_key("_t", "_v", F.lit("Normal"))).drop(*names, "_t", "_v")


def data_budget(counts: DataFrame) -> DataFrame:
    """Enabled layers and tier from bar counts ``monthly weekly daily intraday``."""
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("monthly", "weekly", "daily", "intraday")}
    l0, l1, l2, l3 = c["monthly"] >= 60, c["weekly"] >= 52, c["daily"] >= 120, c["intraday"] >= 300
    full = (c["weekly"] >= 100) & (c["daily"] >= 250) & ((c["monthly"] >= 60) | ~l0)
    return counts.withColumns({"L0_on": l0, "L1_on": l1, "L2_on": l2, "L3_on": l3, "tier": F.when(full, "full").otherwise("lite")})


def proxy_caps(df: DataFrame, market: DataFrame, ts: str = "ts") -> DataFrame:
    """Short histories borrow the market's regime: exposure is capped when the market is not Up."""
    m = market.select(ts, F.col("L2").alias("_mk"))
    out = df.join(m, ts, "left")
    cap = F.when(~F.col("L0_on") & ~bool0(F.col("_mk").startswith("Up")), 0.6).otherwise(1.0)
    size = F.when(~F.col("L1_on") & bool0(F.col("_mk").startswith("Down")), 0.75).otherwise(1.0)
    return out.withColumns({"gross_cap_proxy": cap, "size_mult_proxy": size}).drop("_mk")


# Pattern -> size multiple, stop multiple, gross cap, order style, setups, pyramids (None: not stated).
# The first entry that matches counts. A pattern with * is a glob; any other matches a key that holds all its tokens.
Policy = tuple[str, float, float, float | None, str | None, tuple[str, ...] | None, bool | None]
POLICIES: tuple[Policy, ...] = (
    ("Up-Normal-Normal", 1.00, 1.50, None, "mixed", ("breakout", "pullback"), None),
    ("Up-Low-", 1.10, 1.25, None, "mixed", ("breakout", "pullback"), None),
    ("Up-High-", 0.75, 1.75, None, "conservative", ("pullback",), None),
    ("Sideways-Low-", 0.70, 1.25, None, "passive", ("mean_revert",), None),
    ("Sideways-High-", 0.40, 2.00, None, "passive", ("stand_down", "mean_revert"), None),
    ("Down-", 0.60, 1.60, None, "mixed", ("short_rallies", "hedge"), None),
    ("-Stressed", 0.60, 1.25, None, "passive", None, None),
    ("*-Strongly_Contracting-RiskOff-*", 0.30, 2.00, 0.40, "passive", ("stand_down", "hedge"), False),
    ("*-Contracting-RiskOff-*", 0.50, 1.80, 0.50, "conservative", ("hedge",), False),
    ("Hiking-*-RiskOff-*", 0.55, 1.75, 0.55, "conservative", ("hedge",), False),
    ("*-RiskOff-*", 0.60, 1.70, 0.60, "conservative", ("pullback", "hedge"), None),
    ("*-Unwind", 0.65, 1.65, 0.65, "conservative", None, None),
    ("*-Strongly_Contracting-*", 0.65, 1.60, 0.65, None, None, None),
    ("*-Contracting-*", 0.80, 1.50, 0.80, None, None, None),
    ("Unknown*", 1.0, 1.5, 1.0, None, None, None),
)
UNMATCHED: Policy = ("", 0.8, 1.5, None, "mixed", ("pullback",), None)
NEUTRAL_SIZE, NEUTRAL_STOP, NEUTRAL_CAP, NEUTRAL_ORDERS = 1.0, 1.5, 1.0, "mixed"


def policy(key: Col, table: Sequence[Policy] = POLICIES, unmatched: Policy = UNMATCHED) -> Column:
    """struct(size_mult, stop_mult, gross_cap, orders, setups, pyramids) of the first matching pattern."""
    k = F.coalesce(col(key), F.lit(""))

    def entry(p: Policy) -> Column:
        setups = F.lit(None).cast("array<string>") if p[5] is None else F.array(*[F.lit(x) for x in p[5]])
        return F.struct(
            F.lit(p[1]).alias("size_mult"), F.lit(p[2]).alias("stop_mult"), F.lit(p[3]).cast("double").alias("gross_cap"),
            F.lit(p[4]).cast("string").alias("orders"), setups.alias("setups"), F.lit(p[6]).cast("boolean").alias("pyramids"))

    chain: Column | None = None
    for p in table:
        if "*" in p[0]:
            hit = k.like(p[0].replace("_", "\\_").replace("*", "%"))
        else:
            hit = F.lit(True)
            for token in filter(None, p[0].split("-")):
                hit = hit & k.contains(token)
        chain = F.when(hit, entry(p)) if chain is None else chain.when(hit, entry(p))
    return entry(unmatched) if chain is None else chain.otherwise(entry(unmatched))


def resolve_policy(df: DataFrame, layers: Sequence[str] = ("L2", "L1", "L0", "L3", "L4"), table: Sequence[Policy] = POLICIES) -> DataFrame:
    """Tighten-only merge of the layers' policies, in order, from a neutral start.

    Smallest size and cap, largest stop, pyramids only if no layer forbids them; the last stated order style unless
    passive was met; all stated setups, sorted. A layer without a key (null or empty) changes nothing; a stressed one makes
    orders passive. Adds size_mult, stop_mult, gross_cap, orders, setups, pyramids.
    """
    size, stop, cap = F.lit(NEUTRAL_SIZE), F.lit(NEUTRAL_STOP), F.lit(NEUTRAL_CAP)
    orders, setups, pyramids = F.lit(NEUTRAL_ORDERS), F.array().cast("array<string>"), F.lit(True)
    for i, c in enumerate(layers):
        df = df.withColumn(f"_p{i}", F.when(F.coalesce(F.col(c), F.lit("")) != "", policy(c, table)))
        p = F.col(f"_p{i}")
        size, stop, cap = F.least(size, p["size_mult"]), F.greatest(stop, p["stop_mult"]), F.least(cap, p["gross_cap"])  # nulls are passed over
        stated = F.when(orders == "passive", orders).otherwise(F.coalesce(p["orders"], orders))
        orders = F.when(bool0(F.col(c).contains("Stressed")), F.lit("passive")).otherwise(stated)
        setups = F.coalesce(F.array_sort(F.array_union(setups, p["setups"])), setups)
        pyramids = pyramids & F.coalesce(p["pyramids"], F.lit(True))
    out = {"size_mult": size, "stop_mult": stop, "gross_cap": cap, "orders": orders, "setups": setups, "pyramids": pyramids}
    return df.withColumns(out).drop(*[f"_p{i}" for i in range(len(layers))])


def resolved_sizes(key: Col, table: Sequence[Policy] = POLICIES) -> tuple[Column, Column]:
    """Size and stop multiple that a key alone resolves to."""
    p = policy(key, table)
    return F.least(F.lit(NEUTRAL_SIZE), p["size_mult"]), F.greatest(F.lit(NEUTRAL_STOP), p["stop_mult"])


def is_tightening(old: Col, new: Col, table: Sequence[Policy] = POLICIES) -> Column:
    (size_old, stop_old), (size_new, stop_new) = resolved_sizes(old, table), resolved_sizes(new, table)
    tighter = (size_new < size_old) | (stop_new > stop_old)
    return F.when(col(old).isNull(), F.lit(True)).when(col(old) == col(new), F.lit(False)).otherwise(tighter)


def hold_path(keys: Sequence[object], hold: int, sizes: Mapping[object, tuple[float, float]] | None = None) -> list[object]:
    """Accepted key per row: a looser key must repeat ``hold`` rows, a tighter one is taken at once."""
    out: list[object] = []
    cur: object = None
    pend: object = None
    seen = 0
    started = False
    for k in keys:
        if not started:
            cur, started = k, True
        elif k == cur:
            pend, seen = None, 0
        else:
            tight = False
            if sizes is not None and cur in sizes and k in sizes:
                tight = sizes[k][0] < sizes[cur][0] or sizes[k][1] > sizes[cur][1]
            if tight or hold <= 0:
                cur, pend, seen = k, None, 0
            else:
                seen = seen + 1 if pend == k else 1
                pend = k
                if seen >= hold:
                    cur, pend, seen = k, None, 0
        out.append(cur)
    return out


def hysteresis(df: DataFrame, f: Frame, key: str, hold: int = 3, tighten: bool = True, out: str = "accepted") -> DataFrame:
    """Regime key with the hold rule applied, one scan per key over bar rows."""
    if tighten:
        size, stop = resolved_sizes(key)
        df = df.withColumns({"_sz": size, "_st": stop})

    def kernel(pdf: pd.DataFrame) -> dict[str, object]:
        sizes = None
        if tighten:
            sizes = {k: (a, b) for k, a, b in zip(pdf[key], pdf["_sz"], pdf["_st"])}
        return {out: hold_path(pdf[key].tolist(), hold, sizes)}

    return scan(df, f, kernel, [(out, df.schema[key].dataType)]).drop("_sz", "_st")


def regimes_for_assets(daily: DataFrame, weekly: DataFrame, monthly: DataFrame, keys: Sequence[str] = ("id",), hold: int = 3) -> DataFrame:
    """L0-L2 labels on the daily grid (sparse layers carried as-of), policy and hysteresis."""
    from tideline.operators.asof import asof_join

    f = Frame(keys)
    d = layer_labels(daily, f, "L2").select(*keys, "ts", "close", "L2")
    for src, layer in ((weekly, "L1"), (monthly, "L0")):
        lab = layer_labels(src, f, layer).select(*keys, "ts", layer)
        d = asof_join(d, lab, keys, "ts", [layer]).drop("matched_ts")
    d = hysteresis(d, f, "L2", hold, out="L2_held")
    return resolve_policy(d, ("L2_held", "L1", "L0"))


def emas_wide(long: DataFrame, keys: Sequence[str], periods: Sequence[int], price: str = "close", ts: str = "ts") -> DataFrame:
    """(key, ts, period, ema) rows to one row per key and time with ``{price}_ema_{period}`` columns."""
    p = long.groupBy(*keys, ts).pivot("period", list(periods)).agg(F.first("ema"))
    return p.select(*keys, ts, *[F.col(str(n)).alias(f"{price}_ema_{n}") for n in periods])


# --- flips -----------------------------------------------------------------------------------------
def sign_flips(df: DataFrame, f: Frame, sign_col: str, min_separation: int = 1) -> DataFrame:
    """Rows where the sign changes, at least ``min_separation`` rows after the last kept one."""
    prev = f.lag(sign_col)
    df = df.withColumns({"_rn": f.rn(), "from_sign": prev})
    flips = df.filter(F.col(sign_col).isNotNull() & F.col("from_sign").isNotNull() & (F.signum(sign_col) != F.signum("from_sign")))
    if min_separation > 1:

        def kernel(pdf: pd.DataFrame) -> dict[str, object]:
            keep, last = [], -10**9
            for i in pdf["_rn"].tolist():
                ok = i - last >= min_separation
                last = i if ok else last
                keep.append(ok)
            return {"_keep": keep}

        flips = scan(flips, f, kernel, [("_keep", T.BooleanType())]).filter("_keep").drop("_keep")
    return flips.select(*f.keys, *f.order, F.col("_rn").alias("idx"), "from_sign", F.col(sign_col).alias("to_sign"),
                        F.when(F.col(sign_col) > F.col("from_sign"), "up").otherwise("down").alias("direction"))


def regime_ids(df: DataFrame, f: Frame, flag: Col) -> DataFrame:
    return df.withColumn("_f", bool0(col(flag)).cast("int")).withColumn("regime_id", F.sum("_f").over(f.cum)).drop("_f")


def regime_summary(df: DataFrame, keys: Sequence[str], regime: str, ret: str, ts: str = "ts") -> DataFrame:
    g = df.groupBy(*keys, regime).agg(
        F.count(ret).alias("n_bars"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.avg(ret).alias("avg_return"),
        F.when(F.min(ret) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(ret) > -1, F.col(ret))))) - 1).alias("cum_return"))
    return g.withColumn("duration_days", F.datediff("end", "start") + 1)


def layer_flips(df: DataFrame, keys: Sequence[str], layers: Sequence[str], ts: str = "ts") -> DataFrame:
    """Label changes per layer ignoring NULLs; the first label is a flip without an old regime."""
    tall = df.select(*keys, ts, F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("regime")) for c in layers])).alias("_i")).select(*keys, ts, "_i.*").filter("regime IS NOT NULL")
    f = Frame((*keys, "layer"), (ts,))
    runs = run_ids(tall, f, "regime")
    g = runs.groupBy(*keys, "layer", "run_id", "regime").agg(F.min(ts).alias(ts), F.count(F.lit(1)).alias("_n"))
    f2 = Frame((*keys, "layer"), ("run_id",))
    return g.withColumns({"old_regime": f2.lag("regime"), "old_duration_bars": f2.lag("_n")}).withColumnRenamed("regime", "new_regime").drop("run_id", "_n")


def regime_return_stats(df: DataFrame, keys: Sequence[str], regime: str, fwd: str) -> DataFrame:
    g = df.filter(F.col(regime).isNotNull()).groupBy(*keys, regime).agg(
        F.count(F.lit(1)).alias("n_bars"), F.avg(fwd).alias("mean_fwd"), F.stddev_samp(fwd).alias("std_fwd"))
    return g.withColumn("pct_of_time", div("n_bars", F.sum("n_bars").over(Window.partitionBy(*keys))) * 100.0)


def transition_pnl(df: DataFrame, f: Frame, regime: str, strat: str) -> DataFrame:
    """Strategy return of the rows on which the regime changed, per (from, to)."""
    d = df.withColumn("from_regime", f.lag(regime)).filter(F.col("from_regime").isNotNull() & (F.col("from_regime") != F.col(regime)))
    return d.groupBy(*f.keys, "from_regime", F.col(regime).alias("to_regime")).agg(F.count(F.lit(1)).alias("n"), F.avg(strat).alias("mean_ret"), F.sum(strat).alias("total_ret"))


# --- transitions -----------------------------------------------------------------------------------
def transition_matrix(df: DataFrame, f: Frame, state: str, by: Sequence[str] = ()) -> DataFrame:
    pairs = df.withColumn("to_state", f.lead(state)).filter(F.col(state).isNotNull() & F.col("to_state").isNotNull())
    g = pairs.groupBy(*by, F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("prob", div("n", F.sum("n").over(Window.partitionBy(*by, "from_state"))))


def rolling_transitions(df: DataFrame, f: Frame, state: str, window_days: int, step: str = "month", ts: str = "ts") -> DataFrame:
    """Transition probabilities in the trailing window before each month start.

    A pair is copied to the window ends it belongs to (window length / step of them), not crossed.
    """
    pairs = df.withColumn("to_state", f.lead(state)).filter(F.col(state).isNotNull() & F.col("to_state").isNotNull()).select(
        *f.keys, F.col(ts).cast("date").alias("_d"), F.col(state).alias("from_state"), "to_state")
    last = df.groupBy(*f.keys).agg(F.max(F.col(ts).cast("date")).alias("_last"))
    first_end = F.add_months(F.trunc("_d", step), 1)
    ends = F.sequence(first_end, F.trunc(F.date_add("_d", window_days), step), F.expr("INTERVAL 1 MONTH"))
    spread = pairs.join(last, list(f.keys)).filter(first_end <= F.trunc(F.date_add("_d", window_days), step)).withColumn("window_end", F.explode(ends)).filter(
        (F.col("window_end") <= F.col("_last")) & (F.datediff("window_end", "_d") <= window_days))
    g = spread.groupBy(*f.keys, "window_end", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("prob", div("n", F.sum("n").over(Window.partitionBy(*f.keys, "window_end", "from_state"))))


def transition_lookup(matrix: DataFrame, from_state: str, to_state: str, keys: Sequence[str] = ()) -> DataFrame:
    """Probability of one transition at the newest window of each key."""
    hit = matrix.filter((F.col("from_state") == from_state) & (F.col("to_state") == to_state))
    return hit.groupBy(*keys).agg(F.max_by("prob", "window_end").alias("prob"), F.max("window_end").alias("window_end"))


def label_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumns({"share_of_a": div("n", F.sum("n").over(Window.partitionBy(a))), "share_of_all": div("n", F.sum("n").over(Window.partitionBy()))})


