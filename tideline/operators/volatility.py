"""Range, return and exponentially weighted volatility; forecast losses and blending."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Col, Frame, col, div, ln_ratio
from tideline.functions.numeric import chi2_sf
from tideline.functions.smoothing import ewm_mean, ewm_std
from tideline.operators.indicators import true_range

WINDOWS = (20, 63, 126)


def range_terms() -> dict[str, Column]:
    """Per-bar variance terms of the three range estimators."""
    hl, co = ln_ratio("high", "low"), ln_ratio("close", "open")
    return {
        "parkinson": hl * hl / (4.0 * math.log(2.0)),
        "gk": 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co,
        "rs": ln_ratio("high", "close") * ln_ratio("high", "open") + ln_ratio("low", "close") * ln_ratio("low", "open"),
    }


def range_volatility(df: DataFrame, f: Frame, windows: Sequence[int] = WINDOWS, which: Sequence[str] = ("parkinson", "gk", "rs"), periods: int = 252, annualize: bool = True) -> DataFrame:
    terms = range_terms()
    df = df.withColumns({f"_t_{k}": terms[k] for k in which})
    scale = math.sqrt(periods) if annualize else 1.0

    def root(v: Column) -> Column:
        return F.when(v >= 0, F.sqrt(v)) * scale

    return df.withColumns(
        {f"vol_{k}_{n}": root(f.mean(f"_t_{k}", n)) for k in which for n in windows}
    ).drop(*[f"_t_{k}" for k in which])


def atr_wilder(df: DataFrame, f: Frame, n: int = 14, out: str | None = None) -> DataFrame:
    return ewm_mean(df.withColumn("_tr", true_range(f)), f, "_tr", {out or f"atr_wilder_{n}": 1.0 / n}).drop("_tr")


def return_volatility(df: DataFrame, f: Frame, windows: Sequence[int] = WINDOWS, types: Sequence[str] = ("log", "pct"), ddof: int = 0, periods: int = 252, x: str = "close", annualize: bool = True) -> DataFrame:
    src = {"log": f.log_return(x), "pct": f.pct(x)}
    df = df.withColumns({f"_r_{t}": src[t] for t in types})
    scale = math.sqrt(periods) if annualize else 1.0
    return df.withColumns(
        {f"vol_{t}_roll_{n}": f.std(f"_r_{t}", n, ddof=ddof) * scale for t in types for n in windows}
    ).drop(*[f"_r_{t}" for t in types])


def volatility_table(df: DataFrame, f: Frame, windows: Sequence[int] = WINDOWS, z: int = 252) -> DataFrame:
    """Every estimator, the z-score of the first window's return volatility and its outlier flag."""
    df = atr_wilder(return_volatility(range_volatility(df, f, windows), f, windows), f)
    base = f"vol_log_roll_{windows[0]}"
    df = df.withColumn(f"{base}_z", f.zscore(base, z, need=max(30, windows[0])))
    return df.withColumn(f"{base}_is_outlier", F.coalesce(F.abs(f"{base}_z") > 4, F.lit(False)))


def daily_vol(df: DataFrame, f: Frame, n: int = 100, x: str = "close", out: str = "daily_vol") -> DataFrame:
    df = df.withColumn("_lr", f.log_return(x))
    return ewm_std(df, f, "_lr", out, n).drop("_lr")


# --- forecast evaluation ---------------------------------------------------------------------------
def rmse(forecast: Col, realized: Col) -> Column:
    e = F.greatest(col(forecast), F.lit(1e-8)) - F.greatest(col(realized), F.lit(1e-8))
    return F.sqrt(F.avg(e * e))


def qlike(forecast: Col, realized: Col) -> Column:
    """mean(ln s2 + r2 / s2), variances not below 1e-16."""
    s2 = F.greatest(col(forecast) * col(forecast), F.lit(1e-16))
    r2 = F.greatest(col(realized) * col(realized), F.lit(1e-16))
    return F.avg(F.log(s2) + r2 / s2)


def mincer_zarnowitz_r2(forecast: Col, realized: Col) -> Column:
    return F.regr_r2(col(realized), col(forecast))


def combined_score(rmse_col: Col, qlike_col: Col, weight: float = 0.5) -> Column:
    return weight * col(rmse_col) + (1 - weight) * col(qlike_col)


def forecast_losses(long: DataFrame, keys: Sequence[str], forecast: str = "forecast", realized: str = "realized") -> DataFrame:
    return long.filter(F.col(forecast).isNotNull() & F.col(realized).isNotNull()).groupBy(*keys).agg(
        rmse(forecast, realized).alias("rmse"),
        qlike(forecast, realized).alias("qlike"),
        mincer_zarnowitz_r2(forecast, realized).alias("mz_r2"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("score", combined_score("rmse", "qlike"))


def trailing_rmse(long: DataFrame, f: Frame, n: int = 63) -> DataFrame:
    """RMSE over the last n scored rows per estimator; ``f`` must be keyed by estimator too."""
    e = F.col("forecast") - F.col("realized")
    return long.withColumn("_e2", e * e).withColumn("trailing_rmse", F.sqrt(f.mean("_e2", n))).drop("_e2")


def blend_weights(errors: DataFrame, by: Sequence[str], rmse_col: str = "rmse", floor: float = 0.05, rounds: int = 3) -> DataFrame:
    """Inverse-error weights per group. A weight under the floor is fixed at it and the rest of the mass
    goes to the others in proportion; repeated, since the rescaling can push another one under."""
    w = Window.partitionBy(*by)
    inv = F.try_divide(F.lit(1.0), F.when(F.col(rmse_col) > 0, F.col(rmse_col)))
    df = errors.withColumn("_inv", inv)
    df = df.withColumns(
        {
            "weight": F.try_divide(F.col("_inv"), F.sum("_inv").over(w)),
            "_fl": F.least(F.lit(floor), F.try_divide(F.lit(1.0), F.count("_inv").over(w).cast("double"))),
            "_lock": F.lit(False),
        }
    )
    for _ in range(rounds):
        df = df.withColumn("_lock", F.col("_lock") | F.coalesce(F.col("weight") < F.col("_fl") - 1e-12, F.lit(False)))
        free = F.when(~F.col("_lock"), F.col("_inv"))
        mass = 1.0 - F.col("_fl") * F.count_if(F.col("_lock")).over(w)
        df = df.withColumn(
            "weight",
            F.when(F.col("_lock"), F.col("_fl")).otherwise(F.try_divide(F.col("_inv"), F.sum(free).over(w)) * mass),
        )
    return df.drop("_inv", "_fl", "_lock")


def blended_vol(forecasts: DataFrame, weights: DataFrame, keys: Sequence[str], estimator: str = "estimator", ts: str = "ts") -> DataFrame:
    """Weighted sum of the latest forecast of each estimator."""
    latest = forecasts.filter(F.col("forecast").isNotNull()).groupBy(*keys, estimator).agg(
        F.max_by("forecast", ts).alias("forecast")
    )
    return latest.join(weights, [*keys, estimator]).groupBy(*keys).agg(
        div(F.sum(F.col("forecast") * F.col("weight")), F.sum("weight")).alias("blended_vol"), F.count(F.lit(1)).alias("n_estimators")
    )


def carried_forecast(forecasts: DataFrame, keys: Sequence[str], as_of: Col, half_life_days: float = 5.0) -> DataFrame:
    """Last converged forecast, decayed by its age in days."""
    last = forecasts.filter("converged").groupBy(*keys).agg(
        F.max_by("forecast", "ts").alias("forecast"), F.max("ts").alias("forecast_ts")
    )
    age = F.datediff(col(as_of), "forecast_ts")
    return last.withColumn("age_days", age).withColumn(
        "carried", F.col("forecast") * F.exp(-math.log(2.0) / half_life_days * F.col("age_days"))
    )


def gk_fallback(bars: DataFrame, keys: Sequence[str], n: int = 21) -> DataFrame:
    """Garman-Klass volatility of the latest n bars."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    recent = bars.withColumns({"_r": F.row_number().over(w), "_t": range_terms()["gk"]}).filter(F.col("_r") <= n)
    return recent.groupBy(*keys).agg(F.sqrt(F.greatest(F.avg("_t"), F.lit(0.0))).alias("gk_vol"), F.count("_t").alias("n"))


def ljung_box(df: DataFrame, f: Frame, x: str, lags: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Smallest Ljung-Box p-value over the lag counts, per key."""
    from tideline.operators.indicators import acf

    m = max(lags)
    rows = acf(df, f, x, m).filter("lag > 0")
    n = df.filter(F.col(x).isNotNull()).groupBy(*f.keys).agg(F.count(F.lit(1)).alias("n"))
    q = rows.join(n, list(f.keys)).withColumn("_t", F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    g = q.groupBy(*f.keys).agg(
        F.first("n").alias("n"), *[F.sum(F.when(F.col("lag") <= k, F.col("_t"))).alias(f"_q{k}") for k in lags]
    )
    stats = {f"q_{k}": F.col("n") * (F.col("n") + 2) * F.col(f"_q{k}") for k in lags}
    g = g.withColumns(stats).withColumns({f"p_{k}": chi2_sf(f"q_{k}", k) for k in lags})
    return g.withColumn("p_min", F.least(*[F.col(f"p_{k}") for k in lags])).drop(*[f"_q{k}" for k in lags])


# --- GARCH(1,1) ------------------------------------------------------------------------------------
def garch_loglik(r2: np.ndarray, omega: float, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gaussian log-likelihood of many (alpha, beta) at once with variance targeting."""
    v0 = r2.mean()
    h = np.full(len(alpha), v0)
    ll = np.zeros(len(alpha))
    om = v0 * (1 - alpha - beta)
    for x in r2:
        ll -= np.log(h) + x / h
        h = om + alpha * x + beta * h
    return ll / 2


def fit_garch(df: DataFrame, f: Frame, x: str, min_obs: int = 126) -> DataFrame:
    """GARCH(1,1) per key: grid over (alpha, beta), refined twice around the best point.

    A key with fewer than ``min_obs`` returns or without variance gives a row too: converged false, a message, no values.
    """
    fields = [df.schema[k] for k in f.keys] + [
        T.StructField(n, T.DoubleType()) for n in ("omega", "alpha", "beta", "loglik", "forecast")
    ] + [T.StructField("n", T.LongType()), T.StructField("converged", T.BooleanType()), T.StructField("message", T.StringType())]
    schema = T.StructType(fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(list(f.order))[x].dropna().to_numpy(dtype=float)
        keys = {k: [pdf[k].iloc[0]] for k in f.keys}
        if len(r) < min_obs or r.std() == 0:
            why = f"{len(r)} of {min_obs} observations" if len(r) < min_obs else "no variance"
            return pd.DataFrame(keys | {n: [None] for n in ("omega", "alpha", "beta", "loglik", "forecast")} | {"n": [len(r)], "converged": [False], "message": [why]})
        r2 = (r - r.mean()) ** 2
        a, b, step = 0.1, 0.8, 0.1
        for _ in range(3):
            ga, gb = np.meshgrid(a + step * np.arange(-4, 5) / 4, b + step * np.arange(-8, 9) / 8 * 2)
            ok = (ga > 0.001) & (gb >= 0) & (ga + gb < 0.999)
            ga, gb = ga[ok], gb[ok]
            ll = garch_loglik(r2, 0.0, ga, gb)
            i = int(ll.argmax())
            a, b, step = float(ga[i]), float(gb[i]), step / 4
        om = float(r2.mean() * (1 - a - b))
        h = r2.mean()
        for v in r2:
            h = om + a * v + b * h
        out = keys | {"omega": [om], "alpha": [a], "beta": [b], "loglik": [float(ll[i])], "forecast": [float(np.sqrt(h))], "n": [len(r)], "converged": [True], "message": [""]}
        return pd.DataFrame(out)

    return df.groupBy(*f.keys).applyInPandas(run, schema)


def garch_out_of_sample(df: DataFrame, f: Frame, x: str, train: int = 252, step: int = 126) -> DataFrame:
    """Expanding-window fits: one group per (key, split), so fits of one key run in parallel."""
    rows = df.filter(F.col(x).isNotNull()).withColumn("_rn", f.rn())
    n = rows.groupBy(*f.keys).agg(F.max("_rn").alias("_n"))
    splits = n.withColumn("split_end", F.explode_outer(F.when(F.col("_n") > train, F.sequence(F.lit(train), F.col("_n") - 1, F.lit(step))))).drop("_n")
    fits = rows.join(splits.filter("split_end IS NOT NULL"), list(f.keys)).filter(F.col("_rn") <= F.col("split_end"))
    fitted = fit_garch(fits, Frame((*f.keys, "split_end"), f.order), x, min_obs=min(train, 126))
    nxt = rows.select(*f.keys, (F.col("_rn") - 1).alias("split_end"), F.abs(x).alias("realized"))
    return fitted.join(nxt, [*f.keys, "split_end"])
