"""Macro features, labels and risk gates over a daily wide series table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col, div
from tideline.operators.regimes import hysteresis

# Thresholds of the macro labels.
T = {
    "hiking": 0.25, "cutting": -0.25, "strong_z": 1.0, "vix_off": 25.0, "vix_on": 15.0, "hy_off": 1.5, "hy_on": -0.5,
    "nfci_off": 0.5, "nfci_on": -0.5, "unwind_z": 2.0, "stress_vol": 1.5, "narrowing_5d": 0.0, "hold": 5,
}
# State by key prefix, most adverse first.
STATE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("adverse", ("Hiking-Strongly_Contracting", "Hiking-Contracting-RiskOff", "Cutting-Strongly_Contracting-RiskOff")),
    ("cautious", ("Hiking-Contracting", "Hiking-Neutral-RiskOff", "Holding-Contracting-RiskOff")),
    ("favorable", ("Cutting-Expanding-RiskOn", "Cutting-Strongly_Expanding")),
    ("constructive", ("Holding-Expanding", "Cutting-Expanding", "Cutting-Neutral")),
)


def z_fill(f: Frame, x: Col, n: int) -> Column:
    """Rolling z that needs 80 % of the window."""
    return f.zscore(x, n, max(1, int(0.8 * n)))


def derived(df: DataFrame, f: Frame) -> DataFrame:
    """Net liquidity, rate spreads, curve change, VIX bucket and dollar changes."""
    vix = F.col("vix")
    return df.withColumns(
        {
            "net_liquidity": F.col("fed_assets") - F.col("treasury_account") - F.col("reverse_repo"),
            "us_jp_rate_spread": F.col("us_rate") - F.col("jp_rate"),
            "us_ecb_rate_spread": F.col("us_rate") - F.col("ecb_rate"),
            "us_jp_10y_spread": F.col("us_10y") - F.col("jp_10y"),
            "yc_slope_change_5d": f.diff("yc_slope", 5),
            "vix_regime": F.when((vix > 0) & (vix <= 15), "calm").when((vix > 15) & (vix <= 25), "elevated").when(vix > 25, "crisis"),
            "dollar_5d_change": f.diff("dollar", 5),
            "dollar_20d_change": f.diff("dollar", 20),
        }
    )


def fed_regime(df: DataFrame, f: Frame, upper: str = "target_upper", lower: str = "target_lower", rate: str = "us_rate") -> DataFrame:
    mid, spread = (F.col(upper) + F.col(lower)) / 2.0, F.col(upper) - F.col(lower)
    df = df.withColumns({"target_mid": mid, "target_spread": spread})
    df = df.withColumn("rate_90d_change", f.diff(rate, 90)).withColumn("_c", F.col("rate_90d_change"))
    structure = F.when(F.col("target_mid") <= 0.25, "zero-bound").when(F.col("target_spread") == 0, "single-target").when(F.col("target_mid").isNotNull(), "target-range")
    path = F.when(F.col("_c") > T["hiking"], "hiking").when(F.col("_c") < T["cutting"], "cutting").when(F.col("_c").isNotNull(), "holding")
    return df.withColumns({"fed_structure": structure, "fed_trajectory": path}).drop("_c")


def stress_features(df: DataFrame, f: Frame) -> DataFrame:
    """Credit, conditions, money growth, carry and liquidity features with an 80 % fill guard."""
    df = df.withColumns({"_r": f.pct("yen") * 100.0, "_mom": f.pct("cpi", 30) * 100.0, "_nf": f.diff("nfci", 28)})
    ma30, ma150 = f.mean("net_liquidity", 30, 24), f.mean("net_liquidity", 150, 120)
    df = df.withColumns(
        {
            "hy_oas_5d_change": f.diff("hy_oas", 5),
            "hy_oas_30d_zscore": z_fill(f, "hy_oas", 30),
            "nfci_direction": F.when(F.col("_nf") > 0, "rising").when(F.col("_nf") < 0, "falling"),
            "m2_yoy_pct": f.pct("m2", 365) * 100.0,
            "yen_5d_pct_change": f.pct("yen", 5) * 100.0,
            "yen_20d_vol": f.std("_r", 20, 16),
            "yen_daily_zscore": f.zscore("_r", 20, 16),
            "net_liquidity_365d_zscore": z_fill(f, "net_liquidity", 365),
            "_trend": ma30 - ma150,
            "cpi_surprise": F.col("_mom") - f.mean("_mom", 90, 72),
            "spread_5d_change": f.diff("us_jp_rate_spread", 5),
        }
    )
    limit = F.when(F.col("us_jp_rate_spread") > 0, 2.0).otherwise(1.5)
    return df.withColumns(
        {
            "net_liquidity_trend": F.when(F.col("_trend") > 0, "expanding").when(F.col("_trend") < 0, "contracting"),
            "carry_momentum": (F.abs("yen_daily_zscore") > limit).cast("double"),
        }
    ).drop("_r", "_mom", "_nf", "_trend")


def index_features(long: DataFrame, f: Frame, x: str = "value") -> DataFrame:
    """Per equity index: % returns, 21-day volatility, drawdown from the 252-day high, MA ratio, z252."""
    df = long.withColumn("_r", f.pct(x) * 100.0)
    cols = {f"ret_{n}d": f.pct(x, n) * 100.0 for n in (1, 5, 21, 63)}
    cols |= {
        "vol_21d": f.std("_r", 21, 17),
        "drawdown_pct": (div(x, f.max(x, 252, 1)) - 1) * 100.0,
        "ma_ratio_50_200d": div(f.mean(x, 50, 40), f.mean(x, 200, 160)),
        "zscore_252d": z_fill(f, x, 252),
    }
    return df.withColumns(cols).drop("_r")


def labels(df: DataFrame) -> DataFrame:
    """Monetary, liquidity, risk and carry labels and their composite key."""
    known = lambda c: F.col(c).isNotNull()
    monetary = F.when(known("fed_trajectory"), F.initcap("fed_trajectory")).when(F.col("rate_90d_change") > T["hiking"], "Hiking").when(
        F.col("rate_90d_change") < T["cutting"], "Cutting").when(known("rate_90d_change"), "Holding")
    z, tr = F.col("net_liquidity_365d_zscore"), F.col("net_liquidity_trend")
    liquidity = F.when(z.isNull() & tr.isNull(), F.lit(None)).when(z > T["strong_z"], "Strongly_Expanding").when(z < -T["strong_z"], "Strongly_Contracting").when(
        tr == "expanding", "Expanding").when(tr == "contracting", "Contracting").otherwise("Neutral")
    vix, hy, nf = F.col("vix"), F.col("hy_oas_30d_zscore"), F.col("nfci")
    off = (vix > T["vix_off"]) | F.coalesce(hy > T["hy_off"], F.lit(False)) | F.coalesce(nf > T["nfci_off"], F.lit(False))
    on = (vix < T["vix_on"]) & F.coalesce(hy < T["hy_on"], F.lit(True)) & F.coalesce(nf < T["nfci_on"], F.lit(True))
    risk = F.when(vix.isNull(), F.lit(None)).when(off, "RiskOff").when(on, "RiskOn").otherwise("Neutral")
    cz = F.col("yen_daily_zscore")
    carry = F.when(cz.isNull(), F.lit(None)).when((cz > T["unwind_z"]) & F.coalesce(F.col("spread_5d_change") < T["narrowing_5d"], F.lit(False)), "Unwind").when(
        F.coalesce(F.col("yen_20d_vol") > T["stress_vol"], F.lit(False)), "Stress").otherwise("Stable")
    df = df.withColumns({"monetary": monetary, "liquidity": liquidity, "risk": risk, "carry": carry})
    return df.withColumn("regime_key", composite_key())


def composite_key(cols: Sequence[str] = ("monetary", "liquidity", "risk", "carry")) -> Column:
    return F.concat_ws("-", *[F.coalesce(F.col(c), F.lit("Unknown")) for c in cols])


def macro_state(key: Col, rules: Sequence[tuple[str, Sequence[str]]] = STATE_RULES, default: str = "neutral") -> Column:
    """First state whose prefix list matches; the adverse ones are tried first."""
    chain: Column | None = None
    for state, prefixes in rules:
        for prefix in prefixes:
            hit = col(key).startswith(prefix)
            chain = F.when(hit, state) if chain is None else chain.when(hit, state)
    assert chain is not None
    return chain.otherwise(default)


def classify(df: DataFrame, f: Frame, hold: int = int(T["hold"])) -> DataFrame:
    """Labels with a hold rule per dimension, composite key and state."""
    df = labels(df)
    for c in ("monetary", "liquidity", "risk", "carry"):
        df = hysteresis(df, f, c, hold, tighten=False, out=f"{c}_held")
    df = df.withColumn("held_key", composite_key([f"{c}_held" for c in ("monetary", "liquidity", "risk", "carry")]))
    return df.withColumn("macro_state", macro_state("held_key"))


# --- gates -----------------------------------------------------------------------------------------
def _gate(cases: Sequence[tuple[Column, str, float]]) -> Column:
    chain: Column | None = None
    for cond, state, mult in cases:
        v = F.struct(F.lit(state).alias("state"), F.lit(mult).alias("mult"))
        c = F.coalesce(cond, F.lit(False))
        chain = F.when(c, v) if chain is None else chain.when(c, v)
    assert chain is not None
    return chain.otherwise(F.struct(F.lit("normal").alias("state"), F.lit(1.0).alias("mult")))


def vix_gate(vix: Col, flatten: float | None = None) -> Column:
    cases = [(col(vix) > 30.0, "reduce", 0.5)]
    return _gate(([(col(vix) > flatten, "flatten", 0.0)] if flatten is not None else []) + cases)


def carry_gate(z: Col, flatten: float | None = None) -> Column:
    cases = [(F.abs(col(z)) > 2.0, "reduce", 0.6)]
    return _gate(([(F.abs(col(z)) > flatten, "flatten", 0.0)] if flatten is not None else []) + cases)


def credit_gate(z: Col) -> Column:
    return _gate([(col(z) > 2.5, "reduce", 0.4), (col(z) > 1.5, "reduce", 0.7)])


def business_days_between(a: Col, b: Col) -> Column:
    """Weekdays after ``a`` up to and including ``b`` (no holiday calendar)."""
    ordinal = lambda d: F.datediff(d, F.lit("1970-01-05").cast("date"))
    count = lambda d: F.floor(ordinal(d) / 7) * 5 + F.least(F.pmod(ordinal(d), F.lit(7)), F.lit(4))
    return F.greatest(count(col(b)) - count(col(a)), F.lit(0))


def freshness_gate(long: DataFrame, as_of: Column, warn: int = 3, disable: int = 6, ts: str = "ts") -> DataFrame:
    worst = long.groupBy("series").agg(F.max(F.col(ts).cast("date")).alias("last_date")).withColumn("stale_days", business_days_between("last_date", as_of))
    g = worst.agg(F.max("stale_days").alias("worst_stale"), F.count_if(F.col("stale_days") > warn).alias("n_stale"))
    return g.withColumn("gate", _gate([(F.col("worst_stale") > disable, "reduce", 0.5), (F.col("worst_stale") > warn, "reduce", 0.8)])).select("worst_stale", "n_stale", "gate.*")


def stress_score(vix: Col, hy_z: Col, carry_z: Col, nfci: Col, weights: Mapping[str, float] | None = None) -> Column:
    """0..100 weighted score over the inputs that are present."""
    w = weights or {"vix": 0.4, "hy": 0.25, "carry": 0.2, "nfci": 0.15}
    unit = lambda x, lo, hi: F.when(col(x).isNotNull(), F.least(F.greatest((col(x) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    parts = {"vix": unit(vix, 12.0, 45.0), "hy": unit(hy_z, -1.0, 3.0), "carry": unit(F.abs(col(carry_z)), 0.0, 3.0), "nfci": unit(nfci, -0.5, 1.0)}
    num = sum((F.coalesce(v * w[k], F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w[k]).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    return F.try_divide(num, den) * 100.0


def stress_tier(score: Col) -> Column:
    return F.when(col(score) < 25, "calm").when(col(score) < 50, "watch").when(col(score) < 75, "stress").when(col(score).isNotNull(), "crisis")
