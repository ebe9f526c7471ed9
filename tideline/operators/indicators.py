"""Technical indicators. Each adds columns to a bar table; inputs are open/high/low/close/volume."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Frame, col, div, sign
from tideline.functions.smoothing import block_sums, ewm_columns, ewm_mean, ewm_span, in_blocks
from tideline.plans.scan import scan


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def true_range(f: Frame) -> Column:
    """Largest of high-low and the gaps to the previous close; the first row has high-low only."""
    prev = f.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def rsi(df: DataFrame, f: Frame, n: int | Sequence[int] = 14, x: str = "close", out: str | None = None) -> DataFrame:
    """Wilder strength index of one or more lengths: all gains and losses are smoothed in one pass."""
    lengths = [n] if isinstance(n, int) else list(n)
    df = df.withColumn("_s", f.diff(x).cast("double"))
    gain, loss = F.greatest(F.col("_s"), F.lit(0.0)), F.greatest(-F.col("_s"), F.lit(0.0))
    specs = {f"_g{k}": (gain, 1.0 / k) for k in lengths} | {f"_l{k}": (loss, 1.0 / k) for k in lengths}
    df = ewm_columns(df, f, "_s", specs)
    cols = {(out or f"rsi_{k}"): 100.0 - 100.0 / (1.0 + div(f"_g{k}", f"_l{k}")) for k in lengths}
    return df.withColumns(cols).drop("_s", *specs)


def macd(df: DataFrame, f: Frame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> DataFrame:
    return macd_many(df, f, [(fast, slow, signal)], x)


def macd_many(df: DataFrame, f: Frame, sets: Sequence[tuple[int, int, int]], x: str = "close") -> DataFrame:
    """MACD lines of several (fast, slow, signal) sets in two smoothing passes."""
    spans = {f"_m{k}": k for s in sets for k in s[:2]}
    decay = lambda k: 1.0 - 2.0 / (k + 1)
    seeded = lambda c, k: (F.when(F.col("_nx") == 1, F.col(c)).otherwise(F.col(c) * (1.0 - decay(k))), decay(k))
    df = df.withColumns({"_x": F.col(x).cast("double"), "_nx": F.count(x).over(f.cum)})
    df, rows = in_blocks(df, "_nx", [decay(k) for s in sets for k in s])
    seen = F.col("_x").isNotNull()
    df = block_sums(df, f, seen, "_nx", rows, {m: seeded("_x", k) for m, k in spans.items()})
    df = df.withColumns({f"macd_{a}_{b}": F.col(f"_m{a}") - F.col(f"_m{b}") for a, b, _ in sets})
    df = block_sums(df, f, seen, "_nx", rows, {f"macd_signal_{a}_{b}_{c}": seeded(f"macd_{a}_{b}", c) for a, b, c in sets})
    df = df.drop("_x", "_nx", "_blk", "_k")
    return df.withColumns(
        {f"macd_hist_{a}_{b}_{c}": F.col(f"macd_{a}_{b}") - F.col(f"macd_signal_{a}_{b}_{c}") for a, b, c in sets}
    ).drop(*spans)


def stochastic(df: DataFrame, f: Frame, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = f.min("low", k), f.max("high", k)
    df = df.withColumn(f"stoch_k_{k}", 100.0 * div(F.col("close") - lo, hi - lo))
    return df.withColumn(f"stoch_d_{d}", f.mean(f"stoch_k_{k}", d))


def bollinger(df: DataFrame, f: Frame, n: int = 20, sigma: float = 2.0, x: str = "close") -> DataFrame:
    df = df.withColumns({f"bb_ma_{n}": f.mean(x, n), "_sd": f.std(x, n)})
    ma = F.col(f"bb_ma_{n}")
    return df.withColumns(
        {
            f"bb_up_{n}": ma + sigma * F.col("_sd"),
            f"bb_lo_{n}": ma - sigma * F.col("_sd"),
            f"bb_width_{n}": div(2 * sigma * F.col("_sd"), ma),
        }
    ).drop("_sd")


def atr(df: DataFrame, f: Frame, n: int = 14, out: str | None = None) -> DataFrame:
    """Simple mean of the true range."""
    return df.withColumn("_tr", true_range(f)).withColumn(out or f"atr_{n}", f.mean("_tr", n)).drop("_tr")


def _directional(df: DataFrame, f: Frame) -> DataFrame:
    up, dn = f.diff("high"), f.lag("low") - F.col("low")
    return df.withColumns(
        {
            "_pdm": F.when((up > dn) & (up > 0), up).otherwise(0.0),
            "_mdm": F.when((dn > up) & (dn > 0), dn).otherwise(0.0),
            "_tr": true_range(f),
        }
    )


def adx(df: DataFrame, f: Frame, n: int = 14, out: str | None = None) -> DataFrame:
    """Rolling-sum directional index averaged over n rows (not Wilder-smoothed)."""
    df = _directional(df, f).withColumn("_atr", f.mean("_tr", n))
    df = df.withColumns({"_pdi": div(100.0 * f.sum("_pdm", n), "_atr"), "_mdi": div(100.0 * f.sum("_mdm", n), "_atr")})
    df = df.withColumn("_dx", 100.0 * div(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")))
    return df.withColumn(out or f"adx_{n}", f.mean("_dx", n)).drop("_pdm", "_mdm", "_tr", "_atr", "_pdi", "_mdi", "_dx")


def adx_wilder(df: DataFrame, f: Frame, n: int = 14, out: str = "adx_w") -> DataFrame:
    """Directional index with 1/n exponential smoothing throughout."""
    df = _directional(df, f)
    for c, o in (("_tr", "_atr"), ("_pdm", "_ps"), ("_mdm", "_ms")):
        df = ewm_mean(df, f, c, {o: 1.0 / n})
    pdi, mdi = div(100.0 * F.col("_ps"), "_atr"), div(100.0 * F.col("_ms"), "_atr")
    df = df.withColumns({"_pdi": pdi, "_mdi": mdi})
    df = df.withColumn("_dx", 100.0 * div(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")))
    # A NULL inside the series re-weights the next value; bars without any movement are rare but legal.
    return ewm_gaps(df, f, {out: ("_dx", 1.0 / n)}).drop("_pdm", "_mdm", "_tr", "_atr", "_ps", "_ms", "_pdi", "_mdi", "_dx")


def ewm_gaps(df: DataFrame, f: Frame, outs: dict[str, tuple[str, float]]) -> DataFrame:
    """Recursive mean where a missing row still ages the past (weights by row distance)."""

    def kernel(pdf: pd.DataFrame) -> dict[str, object]:
        return {
            o: pdf[c].astype("float64").ewm(alpha=a, adjust=False).mean().to_numpy() for o, (c, a) in outs.items()
        }

    return scan(df, f, kernel, [(o, T.DoubleType()) for o in outs])


def obv(df: DataFrame, f: Frame) -> DataFrame:
    signed = F.coalesce(sign(f.diff("close")) * F.col("volume"), F.lit(0.0))
    return df.withColumn("_v", signed).withColumn("obv", f.running(F.sum("_v"))).drop("_v")


def mfi(df: DataFrame, f: Frame, n: int = 14, negated_flow: bool = False) -> DataFrame:
    """Money flow index. ``negated_flow`` keeps the sign slip of the older form (leaves 0..100)."""
    df = df.withColumns({"_tp": typical(), "_raw": typical() * F.col("volume")})
    step = f.diff("_tp")
    df = df.withColumns(
        {"_pos": F.when(step > 0, F.col("_raw")).otherwise(0.0), "_neg": F.when(step < 0, F.col("_raw")).otherwise(0.0)}
    )
    neg = f.sum("_neg", n)
    ratio = div(f.sum("_pos", n), -neg if negated_flow else neg)
    return df.withColumn("_mr", ratio).withColumn(
        f"mfi_{n}", 100.0 - F.try_divide(F.lit(100.0), 1.0 + F.col("_mr"))
    ).drop("_tp", "_raw", "_pos", "_neg", "_mr")


def ichimoku(df: DataFrame, f: Frame, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    """Cloud lines, all causal: spans are not moved forward and chikou is a lag."""
    mid = lambda n: (f.max("high", n) + f.min("low", n)) / 2.0
    df = df.withColumns({"ichimoku_tenkan": mid(tenkan), "ichimoku_kijun": mid(kijun), "ichimoku_span_b": mid(senkou),
                         "ichimoku_chikou": f.lag("close", kijun)})
    return df.withColumn("ichimoku_span_a", (F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2.0)


def williams_r(df: DataFrame, f: Frame, n: int = 14) -> DataFrame:
    hh, ll = f.max("high", n), f.min("low", n)
    return df.withColumn(f"willr_{n}", -100.0 * div(hh - F.col("close"), hh - ll))


def keltner(df: DataFrame, f: Frame, n: int = 20, atr_n: int = 10, mult: float = 2.0) -> DataFrame:
    df = atr(ewm_span(df, f, "close", {f"kc_mid_{n}": n}), f, atr_n, "_katr")
    mid, band = F.col(f"kc_mid_{n}"), mult * F.col("_katr")
    return df.withColumns(
        {f"kc_upper_{n}": mid + band, f"kc_lower_{n}": mid - band, f"kc_width_{n}": div(2 * band, mid)}
    ).drop("_katr")


def cci(df: DataFrame, f: Frame, n: int = 20) -> DataFrame:
    """Deviation uses each bar's own moving average, as the stored values do."""
    df = df.withColumn("_tp", typical()).withColumn("_sma", f.mean("_tp", n))
    df = df.withColumn("_ad", F.abs(F.col("_tp") - F.col("_sma")))
    return df.withColumn(f"cci_{n}", div(F.col("_tp") - F.col("_sma"), 0.015 * f.mean("_ad", n))).drop("_tp", "_sma", "_ad")


def elder_ray(df: DataFrame, f: Frame, n: int = 13) -> DataFrame:
    df = ewm_span(df, f, "close", {"_e": n})
    return df.withColumns(
        {f"elder_bull_{n}": F.col("high") - F.col("_e"), f"elder_bear_{n}": F.col("low") - F.col("_e")}
    ).drop("_e")


def force_index(df: DataFrame, f: Frame, n: int = 13) -> DataFrame:
    df = df.withColumn("fi_1", f.diff("close") * F.col("volume"))
    return ewm_span(df, f, "fi_1", {f"fi_{n}": n})


def rolling_vwap(df: DataFrame, f: Frame, n: int = 14) -> DataFrame:
    df = df.withColumn("_tv", typical() * F.col("volume"))
    df = df.withColumn(f"vwap_{n}", div(f.sum("_tv", n), f.sum("volume", n)))
    return df.withColumn(f"vwap_dev_{n}", div("close", f"vwap_{n}") - 1).drop("_tv")


def money_flow_volume() -> Column:
    """((C-L)-(H-C))/(H-L) * V; NULL on a flat bar."""
    return div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low")) * F.col("volume")


def cmf(df: DataFrame, f: Frame, n: int = 20) -> DataFrame:
    df = df.withColumn("_mfv", money_flow_volume())
    return df.withColumn(f"cmf_{n}", div(f.sum("_mfv", n), f.sum("volume", n))).drop("_mfv")


def chaikin(df: DataFrame, f: Frame, fast: int = 3, slow: int = 10) -> DataFrame:
    df = df.withColumn("_mfv", money_flow_volume())
    df = df.withColumn("_adl", F.when(F.col("_mfv").isNotNull(), f.running(F.sum("_mfv"))))
    df = ewm_gaps(df, f, {"_cf": ("_adl", 2.0 / (fast + 1)), "_cs": ("_adl", 2.0 / (slow + 1))})
    return df.withColumn(f"chaikin_osc_{fast}_{slow}", F.col("_cf") - F.col("_cs")).drop("_mfv", "_adl", "_cf", "_cs")


def hurst(df: DataFrame, f: Frame, n: int = 100, max_lag: int = 20, x: str = "close") -> DataFrame:
    """Slope of ln(std of lag-k differences) on ln k over k = 2..max_lag within the last n rows."""
    lags = np.arange(2, max_lag + 1)
    lx = np.log(lags) - np.log(lags).mean()

    @F.pandas_udf(T.DoubleType())
    def slope(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        keep = [i for i, v in enumerate(values) if v is not None and len(v) == n]
        if keep:
            m = np.stack([np.asarray(values.iloc[i], dtype=float) for i in keep])
            tau = np.stack([np.log((m[:, k:] - m[:, :-k]).std(axis=1) + 1e-16) for k in lags], axis=1)
            out[keep] = (tau - tau.mean(axis=1, keepdims=True)) @ lx / (lx @ lx)
        return pd.Series(out).where(np.isfinite(out), None)

    window = F.when(F.count(x).over(f.last_rows(n)) == n, F.collect_list(x).over(f.last_rows(n)))
    return df.withColumn("_h", window).withColumn(f"hurst_{n}", slope("_h")).drop("_h")


def aroon(df: DataFrame, f: Frame, n: int = 25) -> DataFrame:
    """Rows since the extreme of the last n+1 rows; a tie counts the earliest."""
    df = df.withColumn("_rn", f.rn())
    w = f.last_rows(n + 1)
    up = F.min_by("_rn", F.struct(-F.col("high"), F.col("_rn"))).over(w)
    dn = F.min_by("_rn", F.struct(F.col("low"), F.col("_rn"))).over(w)
    full = F.count("high").over(w) >= n + 1
    df = df.withColumns(
        {
            f"aroon_up_{n}": F.when(full, 100.0 * (n - (F.col("_rn") - up)) / n),
            f"aroon_dn_{n}": F.when(full, 100.0 * (n - (F.col("_rn") - dn)) / n),
        }
    )
    return df.withColumn(f"aroon_osc_{n}", F.col(f"aroon_up_{n}") - F.col(f"aroon_dn_{n}")).drop("_rn")


def trix(df: DataFrame, f: Frame, n: int = 15, signal: int = 9) -> DataFrame:
    df = ewm_span(df, f, "close", {"_e1": n})
    df = ewm_span(df, f, "_e1", {"_e2": n})
    df = ewm_span(df, f, "_e2", {"_e3": n})
    df = df.withColumn(f"trix_{n}", f.pct("_e3") * 100.0)
    return ewm_span(df, f, f"trix_{n}", {f"trix_signal_{signal}": signal}).drop("_e1", "_e2", "_e3")


def ultimate(df: DataFrame, f: Frame, p1: int = 7, p2: int = 14, p3: int = 28) -> DataFrame:
    prev = f.lag("close")
    lo, hi = F.least(F.col("low"), prev), F.greatest(F.col("high"), prev)
    df = df.withColumns({"_bp": F.col("close") - lo, "_tr": hi - lo})
    avg = lambda p: div(f.sum("_bp", p), f.sum("_tr", p))
    return df.withColumn(f"uo_{p1}_{p2}_{p3}", 100.0 * (4 * avg(p1) + 2 * avg(p2) + avg(p3)) / 7.0).drop("_bp", "_tr")


def vortex(df: DataFrame, f: Frame, n: int = 14) -> DataFrame:
    df = df.withColumns(
        {"_p": F.abs(F.col("high") - f.lag("low")), "_m": F.abs(F.col("low") - f.lag("high")), "_tr": true_range(f)}
    )
    return df.withColumns(
        {f"vi_plus_{n}": div(f.sum("_p", n), f.sum("_tr", n)), f"vi_minus_{n}": div(f.sum("_m", n), f.sum("_tr", n))}
    ).drop("_p", "_m", "_tr")


def emv(df: DataFrame, f: Frame, n: int = 14) -> DataFrame:
    move = (F.col("high") + F.col("low")) / 2.0 - (f.lag("high") + f.lag("low")) / 2.0
    box = div(F.col("volume") / 1e6, F.col("high") - F.col("low"))
    return df.withColumn("emv_1", div(move, box)).withColumn(f"emv_{n}", f.mean("emv_1", n))


def mass_index(df: DataFrame, f: Frame, n: int = 9, total: int = 25) -> DataFrame:
    df = df.withColumn("_r", F.col("high") - F.col("low"))
    df = ewm_span(df, f, "_r", {"_e1": n})
    df = ewm_span(df, f, "_e1", {"_e2": n}).withColumn("_q", div("_e1", "_e2"))
    return df.withColumn(f"mass_index_{total}", f.sum("_q", total)).drop("_r", "_e1", "_e2", "_q")


# Fixed values: (rate-of-change rows, smoothing rows, weight) of the know-sure-thing line.
KST_TERMS = ((10, 10, 1), (13, 13, 2), (14, 14, 3), (15, 9, 4))


def kst(df: DataFrame, f: Frame) -> DataFrame:
    df = df.withColumns({f"_roc{i}": f.pct("close", r) * 100.0 for i, (r, _, _) in enumerate(KST_TERMS)})
    line = sum((f.mean(f"_roc{i}", s) * w for i, (_, s, w) in enumerate(KST_TERMS)), F.lit(0.0))
    df = df.withColumn("kst", line)
    return df.withColumn("kst_signal", f.mean("kst", 9)).drop(*[f"_roc{i}" for i in range(len(KST_TERMS))])


def coppock(df: DataFrame, f: Frame, long: int = 14, short: int = 11, n: int = 10) -> DataFrame:
    df = df.withColumns({"_c": (f.pct("close", long) + f.pct("close", short)) * 100.0, "_rn": f.rn()})
    return df.withColumn(f"coppock_{n}", f.wma("_c", n, "_rn")).drop("_c", "_rn")


# --- packs -----------------------------------------------------------------------------------------
PACK: tuple[Callable[[DataFrame, Frame], DataFrame], ...] = (
    lambda d, f: rsi(d, f, (7, 14, 21)),
    lambda d, f: macd_many(d, f, [(12, 26, 9), (8, 17, 9)]),
    stochastic, bollinger, atr, adx,
)


def indicator_pack(df: DataFrame, f: Frame, steps: Sequence[Callable[[DataFrame, Frame], DataFrame]] = PACK) -> DataFrame:
    """All default indicators plus the z-score of rsi_14, one shuffle for the whole pack."""
    for step in steps:
        df = step(df, f)
    return df.withColumn("rsi_14_zscore", f.zscore("rsi_14", 60))


def core_features(df: DataFrame, f: Frame, ema_periods: Sequence[int] = (21, 50), vol_windows: Sequence[int] = (20,), acf_lags: Sequence[int] = (1, 5), acf_window: int = 50) -> DataFrame:
    """Returns, EMAs, rolling volatility and rolling autocorrelation in one pass."""
    df = df.withColumns({"close_pct": f.pct("close"), "close_log": f.log_return("close")})
    df = ewm_span(df, f, "close", {f"ema_{p}": p for p in ema_periods})
    df = df.withColumns({f"vol_{n}": f.std("close_log", n, ddof=0) * (252.0**0.5) for n in vol_windows})
    return rolling_autocorr(df, f, "close_log", acf_lags, acf_window)


def rolling_autocorr(df: DataFrame, f: Frame, x: str, lags: Sequence[int], n: int) -> DataFrame:
    df = df.withColumns({f"_lag{k}": f.lag(x, k) for k in lags})
    return df.withColumns({f"acf_{k}_{n}": f.corr(x, f"_lag{k}", n) for k in lags}).drop(*[f"_lag{k}" for k in lags])


def acf(df: DataFrame, f: Frame, x: str, lags: int) -> DataFrame:
    """Autocorrelation per (key, lag 0..lags) of the demeaned series: lagged products over the total."""
    df = df.filter(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(f.whole))
    df = df.withColumns({f"_p{k}": F.col("_d") * (f.lag("_d", k) if k else F.col("_d")) for k in range(lags + 1)})
    sums = df.groupBy(*f.keys).agg(*[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(lags + 1)])
    items = F.array(*[F.struct(F.lit(k).alias("lag"), div(f"_p{k}", "_p0").alias("acf")) for k in range(lags + 1)])
    return sums.select(*f.keys, F.explode(items).alias("_i")).select(*f.keys, "_i.*")


def pacf(acf_rows: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """Partial autocorrelation per lag by the Levinson recursion on the few acf rows of a key."""
    schema = T.StructType([acf_rows.schema[k] for k in keys] + [T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("lag")["acf"].to_numpy(dtype=float)
        phi, out = np.zeros(0), [1.0]
        for k in range(1, min(lags, len(r) - 1) + 1):
            den = 1.0 - phi @ r[1:k]
            last = (r[k] - phi @ r[1:k][::-1]) / den if den else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        res = pd.DataFrame({"lag": range(len(out)), "pacf": out})
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[c.name for c in schema.fields]]

    return acf_rows.groupBy(*keys).applyInPandas(run, schema)


def xcorr(df: DataFrame, f: Frame, a: str, b: str, max_lag: int) -> DataFrame:
    """Cross-correlation of two demeaned series for every lag in [-max_lag, max_lag]."""
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    df = df.withColumns({"_a": F.col(a) - F.avg(a).over(f.whole), "_b": F.col(b) - F.avg(b).over(f.whole)})
    lags = range(-max_lag, max_lag + 1)
    prod = {k: F.col("_a") * (f.lag("_b", k) if k > 0 else f.lead("_b", -k) if k < 0 else F.col("_b")) for k in lags}
    df = df.withColumns({f"_p{k + max_lag}": v for k, v in prod.items()})
    g = df.groupBy(*f.keys).agg(
        *[F.sum(f"_p{k + max_lag}").alias(f"_p{k + max_lag}") for k in lags],
        F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b"))).alias("_n"),
    )
    items = F.array(*[F.struct(F.lit(k).alias("lag"), div(f"_p{k + max_lag}", "_n").alias("xcorr")) for k in lags])
    return g.select(*f.keys, F.explode(items).alias("_i")).select(*f.keys, "_i.*")


def trend_labels(df: DataFrame, f: Frame, n: int = 20, mode: str = "binary", flat_quantile: float | None = None, x: str = "close") -> DataFrame:
    """Label by the rolling OLS slope; the flat zone is a quantile of |slope| per key. Warm-up is NULL."""
    df = df.withColumn("_rn", f.rn()).withColumn("slope", f.slope(x, "_rn", n)).drop("_rn")
    if mode == "binary":
        return df.withColumn("trend", F.when(F.col("slope") > 0, 1).when(F.col("slope").isNotNull(), -1))
    q = flat_quantile if flat_quantile is not None else (0.33 if mode == "three_state" else 0.20)
    limits = df.groupBy(*f.keys).agg(F.percentile(F.abs("slope"), q).alias("_cut"))
    df = df.join(limits, list(f.keys))
    label = F.when(F.abs("slope") <= F.col("_cut"), 0).when(F.col("slope") > 0, 1).when(F.col("slope") < 0, -1)
    return df.withColumn("trend", label).drop("_cut")


def flip_segments(df: DataFrame, f: Frame, state: str, price: str = "close", ts: str = "ts") -> DataFrame:
    """Runs of equal state: first/last price and time, length and return."""
    from tideline.functions.frames import run_ids

    runs = run_ids(df.filter(col(state).isNotNull()), f, state, "segment")
    return runs.groupBy(*f.keys, "segment", state).agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.min_by(price, ts).alias("start_price"),
        F.max_by(price, ts).alias("end_price"),
        F.count(F.lit(1)).alias("n_bars"),
    ).withColumn("ret", div("end_price", "start_price") - 1)
