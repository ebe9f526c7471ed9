"""Microstructure: fractional differencing, impact slopes, unit-root and entropy features, codependence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.frames import Frame, col, div, sign


def ffd_weights(d: float, threshold: float = 1e-2, max_len: int = 10_000) -> list[float]:
    """Binomial weights of (1 - L)^d, newest first, cut below the threshold."""
    w = [1.0]
    while len(w) < max_len:
        nxt = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(nxt) < threshold:
            break
        w.append(nxt)
    return w


def frac_diff(f: Frame, x, d: float = 0.4, threshold: float = 1e-2) -> Column:
    """Fixed-width fractional difference: a weighted sum of lags (the kernel is a few constants)."""
    w = ffd_weights(d, threshold)
    total: Column = col(x) * w[0]
    for k, v in enumerate(w[1:], 1):
        total = total + f.lag(x, k) * v
    return total


def amihud(df: DataFrame, f: Frame, n: int = 20) -> DataFrame:
    """Mean |return| per dollar traded over the last n rows, NULLs skipped, from row n+1 on."""
    df = df.withColumns({"_q": div(F.abs(f.pct("close")), F.abs(F.col("close") * F.col("volume"))), "_rn": f.rn()})
    return df.withColumn("amihud", F.when(F.col("_rn") > n, F.avg("_q").over(f.last_rows(n)))).drop("_q", "_rn")


def impact_slopes(df: DataFrame, f: Frame, n: int = 20) -> DataFrame:
    """OLS slopes of price change on signed volume (kyle) and signed root dollar volume (hasbrouck)."""
    step = f.diff("close")
    df = df.withColumns({"_dp": step, "_rn": f.rn(), "_sv": sign(step) * F.col("volume"), "_sd": sign(step) * F.sqrt(F.abs(F.col("close") * F.col("volume")))})
    ok = (F.col("_rn") > n) & (F.count("_dp").over(f.last_rows(n)) >= 3)
    slope = lambda x: F.when(ok, F.regr_slope("_dp", x).over(f.last_rows(n)))
    return df.withColumns({"kyle": slope("_sv"), "hasbrouck": slope("_sd")}).drop("_dp", "_rn", "_sv", "_sd")


def adf_tstat(y: np.ndarray, lags: int = 1) -> float:
    """t-statistic of the lagged level in the augmented Dickey-Fuller regression with intercept."""
    n = len(y)
    if n < lags + 5:
        return float("nan")
    dy = np.diff(y)
    dep = dy[lags:]
    cols = [y[lags:-1]] + [dy[lags - k : len(dy) - k] for k in range(1, lags + 1)] + [np.ones(len(dep))]
    x = np.column_stack(cols)
    dof = len(dep) - x.shape[1]
    if dof <= 0:
        return float("nan")
    beta, *_ = np.linalg.lstsq(x, dep, rcond=None)
    res = dep - x @ beta
    try:
        inv = np.linalg.inv(x.T @ x)
    except np.linalg.LinAlgError:
        return float("nan")
    return float(beta[0] / np.sqrt(max(res @ res / dof * inv[0, 0], 1e-20)))


def kpss_stat(y: np.ndarray) -> float:
    n = len(y)
    e = y - y.mean()
    s = np.cumsum(e)
    bw = int(12 * (n / 100.0) ** 0.25)
    v = e @ e / n + 2 * sum((1 - k / (bw + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(bw, n - 1) + 1))
    return float(s @ s / (n * n * v)) if v > 0 else float("nan")


def stationarity(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str] = ("ts",), min_obs: int = 30) -> DataFrame:
    """ADF t and KPSS statistic per group, with a joint verdict (5 % critical values -2.86 and 0.463)."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("adf_t", T.DoubleType()), T.StructField("kpss", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(list(order))[x].dropna().to_numpy(dtype=float)
        if len(y) < min_obs or y.std() == 0:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "adf_t": [adf_tstat(y)], "kpss": [kpss_stat(y)], "n": [len(y)]})

    out = df.select(*keys, *order, x).groupBy(*keys).applyInPandas(run, schema)
    a, k = F.col("adf_t") < -2.86, F.col("kpss") < 0.463
    return out.withColumn("verdict", F.when(a & k, "stationary").when(~a & ~k, "non_stationary").otherwise("ambiguous"))


def minimal_order(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str] = ("ts",), steps: int = 20, limit: float = -2.9) -> DataFrame:
    """Smallest differencing order on the grid 0.1..1.0 whose ADF t passes; one group per (key, order). None passes: null, ``passed`` is false."""
    grid = [0.1 + 0.9 * i / (steps - 1) for i in range(steps)]
    f = Frame(keys, order)
    logs = df.withColumn("_y", F.log(F.greatest(F.col(x), F.lit(1e-12))))
    logs = logs.withColumns({f"_d{i}": frac_diff(f, "_y", d) for i, d in enumerate(grid)})
    items = F.array(*[F.struct(F.lit(float(d)).alias("d"), F.col(f"_d{i}").alias("v")) for i, d in enumerate(grid)])
    tall = logs.select(*keys, *order, F.explode(items).alias("_i")).select(*keys, *order, "_i.*").filter("v IS NOT NULL")
    st = stationarity(tall, [*keys, "d"], "v", order)
    g = st.groupBy(*keys).agg(F.min(F.when(F.col("adf_t") < limit, F.col("d"))).alias("m"))
    return g.select(*keys, F.col("m").alias("min_d"), F.col("m").isNotNull().alias("passed"))


def _window_lists(df: DataFrame, f: Frame, x: str, n: int, name: str) -> DataFrame:
    w = f.last_rows(n)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(f.cum) > n, F.collect_list(x).over(w)))


def rolling_adf(df: DataFrame, f: Frame, x: str = "close", n: int = 63, lags: int = 1) -> DataFrame:
    """ADF t of ln(x) over the last n rows: least squares on a batch of windows in one numpy call."""

    @F.pandas_udf(T.DoubleType())
    def stat(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        keep = [i for i in range(len(v)) if v.iloc[i] is not None and len(v.iloc[i]) == n]
        if keep:
            y = np.stack([np.asarray(v.iloc[i], dtype=float) for i in keep])
            dy = np.diff(y, axis=1)
            dep = dy[:, lags:]
            cols = [y[:, lags:-1]] + [dy[:, lags - k : dy.shape[1] - k] for k in range(1, lags + 1)] + [np.ones_like(dep)]
            m = np.stack(cols, axis=2)
            xtx = np.einsum("bij,bik->bjk", m, m)
            good = np.linalg.cond(xtx) < 1e14
            res = np.full(len(keep), np.nan)
            inv = np.linalg.inv(xtx[good])
            beta = np.einsum("bjk,bk->bj", inv, np.einsum("bij,bi->bj", m[good], dep[good]))
            e = dep[good] - np.einsum("bij,bj->bi", m[good], beta)
            s2 = (e * e).sum(axis=1) / (dep.shape[1] - m.shape[2])
            res[good] = beta[:, 0] / np.sqrt(np.maximum(s2 * inv[:, 0, 0], 1e-20))
            out[keep] = res
        return pd.Series(out).where(np.isfinite(out), None)

    df = df.withColumn("_y", F.log(x))
    return _window_lists(df, f, "_y", n, "_w").withColumn("rolling_adf", stat("_w")).drop("_y", "_w")


def encode_quantiles(a: np.ndarray, bins: int) -> np.ndarray:
    edges = np.unique(np.quantile(a, np.linspace(0, 1, bins + 1)))
    return np.clip(np.searchsorted(edges[1:], a, side="left"), 0, max(len(edges) - 1, 1) - 1)


def entropy_nats(codes: np.ndarray) -> float:
    p = np.bincount(codes) / len(codes)
    p = p[p > 0]
    return float(-(p * np.log(p + 1e-12)).sum())


def phrase_count(codes: Sequence[int]) -> int:
    """LZ76 phrases: grow each phrase while it occurs in the text before its last symbol."""
    s = "".join(chr(48 + int(c)) for c in codes)
    n, start, length, count = len(s), 1, 1, 1
    if n == 0:
        return 0
    while start + length <= n:
        if s.find(s[start : start + length], 0, start + length - 1) >= 0:
            length += 1
        else:
            count, start, length = count + 1, start + length, 1
    return count


def rolling_entropy(df: DataFrame, f: Frame, x: str, n: int = 50, bins: int = 10) -> DataFrame:
    """Shannon entropy (nats) and LZ complexity / log2(n) of quantile-coded values of the last n rows."""

    @F.pandas_udf("entropy double, complexity double")
    def stats(v: pd.Series) -> pd.DataFrame:
        ent, lz = [], []
        for a in v:
            if a is None or len(a) < 3:
                ent.append(None)
                lz.append(None)
                continue
            codes = encode_quantiles(np.asarray(a, dtype=float), bins)
            ent.append(entropy_nats(codes))
            lz.append(phrase_count(codes) / np.log2(max(n, 2)))
        return pd.DataFrame({"entropy": pd.Series(ent, dtype=object), "complexity": pd.Series(lz, dtype=object)})

    return _window_lists(df, f, x, n, "_w").withColumn("_e", stats("_w")).withColumns(
        {"entropy": F.col("_e.entropy"), "complexity": F.col("_e.complexity")}).drop("_w", "_e")


# --- codependence ----------------------------------------------------------------------------------
def quantile_bins(df: DataFrame, by: Sequence[str], x: str, bins: int = 10, out: str | None = None) -> DataFrame:
    """Bin 0..k-1 by the distinct quantile edges of the group (edges by aggregate, joined back)."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile(x, [i / bins for i in range(bins + 1)])).alias("_e"))
    upper = F.slice("_e", 2, bins)
    below = F.size(F.filter(upper, lambda e: e < F.col(x)))
    code = F.greatest(F.least(below, F.size(upper) - 1), F.lit(0))
    return df.join(edges, list(by)).withColumn(out or f"{x}_bin", F.when(F.col(x).isNotNull(), code)).drop("_e")


def entropy_of(df: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    c = df.filter(F.col(code).isNotNull()).groupBy(*by, code).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*by).agg(F.sum("n").alias("_t"), F.sum(F.col("n") * F.log("n")).alias("_nl"))
    return t.select(*by, (F.log("_t") - F.col("_nl") / F.col("_t")).alias("entropy"), F.col("_t").alias("n"))


def mutual_information(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Binned MI, both entropies and the variation of information, from joint counts only.

    The joint counts are at most bins^2 rows per group; all sums run on them.
    """
    j = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    nl = lambda c: F.sum(F.col(c) * F.log(c))
    tot = j.groupBy(*by).agg(F.sum("n").alias("_t"), nl("n").alias("_j"))
    ma = j.groupBy(*by, a).agg(F.sum("n").alias("_n")).groupBy(*by).agg(nl("_n").alias("_a"))
    mb = j.groupBy(*by, b).agg(F.sum("n").alias("_n")).groupBy(*by).agg(nl("_n").alias("_b"))
    g = tot.join(ma, list(by)).join(mb, list(by))
    h = lambda c: F.log("_t") - F.col(c) / F.col("_t")
    g = g.withColumns({"h_a": h("_a"), "h_b": h("_b"), "h_ab": h("_j")})
    g = g.withColumn("mi", F.col("h_a") + F.col("h_b") - F.col("h_ab"))
    return g.withColumn("vi", F.col("h_a") + F.col("h_b") - 2 * F.col("mi")).select(*by, "mi", "vi", "h_a", "h_b", F.col("_t").alias("n"))


def smaller_before(y: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place i: sum of ``values`` (fields, n) over the places j < i with y_j below y_i (equal ones may count either way).

    Places are cut in halves down to single ones. In y order inside a block, what the left half has summed so far is what a place of the
    right half needs; the order of the halves follows from that of the block by counting, so every level costs O(n).
    """
    n, out = len(y), np.zeros_like(values)
    order = np.argsort(y, kind="stable")
    at = np.arange(n)
    for level in range(max(0, (n - 1).bit_length() - 1), -1, -1):
        start = at >> (level + 1) << (level + 1)
        left = order >> level & 1 == 0
        sums = np.concatenate((np.zeros((len(values), 1)), np.cumsum(np.where(left, values[:, order], 0.0), axis=1)), axis=1)
        counts = np.concatenate(([0], np.cumsum(left)))
        right = ~left
        out[:, order[right]] += sums[:, :-1][:, right] - sums[:, start[right]]
        lefts = counts[:-1] - counts[start]
        lengths = np.minimum(1 << level, n - start)  # of the block's left half
        moved = np.empty(n, np.int64)
        moved[np.where(left, start + lefts, start + lengths + (at - start) - lefts)] = order
        order = moved
    return out


def distance_corr(x: np.ndarray, y: np.ndarray) -> float:
    """Szekely distance correlation in O(n log n) time and O(n) memory.

    The product sum of the centred distances is that of the distances, plus a product of means, less one of row sums. In x order a product
    of two distances is (x_i - x_j)(y_i - y_j) with the sign of its second factor, so sums over smaller y suffice (``smaller_before``).
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    n = len(x)

    def row_sums(v: np.ndarray) -> np.ndarray:
        s = np.sort(v)
        cs = np.concatenate([[0.0], np.cumsum(s)])
        k = np.searchsorted(s, v)
        return v * k - cs[k] + (cs[-1] - cs[k]) - v * (n - k)

    def squares(v: np.ndarray) -> float:
        return 2.0 * n * float(v @ v) - 2.0 * float(v.sum()) ** 2

    fields = np.stack((np.ones(n), x, y, x * y))
    before = np.cumsum(fields, axis=1) - fields
    c, sx, sy, sxy = 2 * smaller_before(y, fields) - before
    product = 2.0 * float((c * x * y - x * sy - y * sx + sxy).sum())
    rx, ry = row_sums(x), row_sums(y)
    covariance = lambda d, a, b: d / n**2 + a.sum() * b.sum() / n**4 - 2.0 * float(a @ b) / n**3
    xy, xx, yy = covariance(product, rx, ry), covariance(squares(x), rx, rx), covariance(squares(y), ry, ry)
    den = np.sqrt(max(xx, 0.0) * max(yy, 0.0))
    return float(np.sqrt(max(xy, 0.0) / den)) if den > 0 else 0.0


def codependence(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Pearson, distance correlation, MI and VI per pair (pair groups are bar histories: calendar bound)."""
    from tideline.operators.asof import safe_corr

    by = ["id_a", "id_b"]
    schema = T.StructType([pairs.schema[k] for k in by] + [T.StructField("dcor", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = distance_corr(pdf["a"].to_numpy(dtype=float), pdf["b"].to_numpy(dtype=float))
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in by} | {"dcor": [v]})

    p = pairs.groupBy(*by).agg(safe_corr("a", "b").alias("pearson"))
    coded = quantile_bins(quantile_bins(pairs, by, "a", bins), by, "b", bins)
    mi = mutual_information(coded, by, "a_bin", "b_bin")
    return p.join(pairs.groupBy(*by).applyInPandas(run, schema), by).join(mi, by)


def micro_table(df: DataFrame, f: Frame) -> DataFrame:
    """All microstructure columns: window stage first, then the two list stages."""
    df = df.withColumns({"log_close": F.log("close"), "log_ret": f.log_return("close")})
    df = df.withColumn("ffd_close", frac_diff(f, "log_close", 0.4))
    df = impact_slopes(amihud(df, f), f)
    return rolling_entropy(rolling_adf(df, f), f, "log_ret")
