"""Recursive operators against naive loops, and edge cases."""

import math
from decimal import Decimal as D

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import numeric as N
from tideline.functions.frames import Frame
from tideline.functions.smoothing import ema_seeded, ewm_span, ewm_std
from tideline.operators import averages as A
from tideline.operators import indicators as I
from tideline.operators import labels as L
from tideline.operators import micro as K
from tideline.operators import regimes as Z
from tideline.operators import risk as R

FR = Frame()


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(0)
    parts = []
    for i in (1, 2):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 160)))
        parts.append(pd.DataFrame({"id": i, "ts": pd.date_range("2020-01-01", periods=160), "open": c * 1.001, "high": c * 1.01, "low": c * 0.985, "close": c, "volume": rng.integers(1, 9, 160).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def col(df, name):
    return df.toPandas().sort_values(["id", "ts"])[name].to_numpy(dtype=float)


def per_id(pdf, fn):
    return np.concatenate([fn(g) for _, g in pdf.groupby("id")])


def test_kama_vidya_frama(walk):
    pdf, df = walk

    def kama(g):
        c, out = g.close.to_numpy(), np.full(len(g), np.nan)
        out[9] = c[9]
        for i in range(10, len(c)):
            path = np.abs(np.diff(c[i - 9 : i + 1])).sum()
            er = abs(c[i] - c[i - 9]) / path if path else 0.0
            a = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            out[i] = out[i - 1] + a * (c[i] - out[i - 1])
        return out

    np.testing.assert_allclose(col(A.kama(df, FR, sets=((10, 2, 30),)), "kama_10_2_30"), per_id(pdf, kama), rtol=1e-9)

    def vidya(g):
        c, out = g.close.to_numpy(), np.full(len(g), np.nan)
        for i in range(9, len(c)):
            d = np.diff(c[i - 9 : i + 1])
            u, n = d[d > 0].sum(), -d[d < 0].sum()
            a = abs((u - n) / (u + n)) * 0.2 if u + n else 0.0
            out[i] = c[i] if np.isnan(out[i - 1]) else a * c[i] + (1 - a) * out[i - 1]
        return out

    np.testing.assert_allclose(col(A.vidya(df, FR), "vidya_9"), per_id(pdf, vidya), rtol=1e-9)


def test_seeded_ema_with_nulls(spark):
    x = [None, 1.0, None, 2.0, 3.0, 4.0, None, 5.0, 6.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "id int, ts int, x double")
    got = ema_seeded(df, FR, "x", "e", 0.5, 3).orderBy("ts").toPandas().e.tolist()
    assert [None if v != v else v for v in got] == [None, None, None, None, None, 3.0, 3.0, 4.0, 5.0]


def test_ewm_std_matches_pandas(walk):
    pdf, df = walk
    want = pdf.groupby("id").close.transform(lambda v: v.pct_change().ewm(span=20).std())
    got = col(ewm_std(df.withColumn("r", FR.pct("close")), FR, "r", "s", 20), "s")
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_gap_aware_smoothing(spark):
    x = [1.0, None, 3.0, None, None, 2.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "id int, ts int, x double")
    got = I.ewm_gaps(df, FR, {"e": ("x", 0.4)}).orderBy("ts").toPandas().e
    np.testing.assert_allclose(got.astype(float), pd.Series(x).ewm(alpha=0.4, adjust=False).mean())


def test_rsi_starts_on_second_row_and_constant_is_null(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 5, 5, 5])] + [(2, i, float(v)) for i, v in enumerate([5, 4, 6, 5])], "id int, ts int, close double")
    p = I.rsi(df, FR, 3).orderBy("id", "ts").toPandas().rsi_3.tolist()
    assert all(v != v or v is None for v in p[:5])
    assert p[5] == 0.0 and 0 < p[6] < 100


def test_cusum_and_hysteresis():
    marks = L.cusum_marks(np.array([np.nan, 0.6, 0.6, -0.9, -0.3, 0.2]), 1.0)
    assert marks.tolist() == [False, False, True, False, True, False]
    sizes = {"a": (1.0, 1.0), "b": (0.5, 1.0), "c": (0.8, 1.0)}
    assert Z.hold_path(["a", "b", "c", "c", "c", "a"], 3, sizes) == ["a", "b", "b", "b", "c", "c"]
    assert Z.hold_path(["a", "b", "b", "b"], 3) == ["a", "a", "a", "b"]


@pytest.mark.parametrize(
    "state, fill, want",
    [
        ((0, 0, 0), (10, 5), (10, 5, 0)), ((10, 5, 0), (10, 7), (20, 6, 0)), ((10, 5, 0), (-4, 8), (6, 5, 12)), ((10, 5, 1), (-10, 4), (0, 0, -9)),
        ((10, 5, 0), (-15, 6), (-5, 6, 10)), ((0, 0, 2), (-3, 9), (-3, 9, 2)), ((-3, 9, 0), (-3, 11), (-6, 10, 0)), ((-6, 10, 0), (2, 8), (-4, 10, 4)),
        ((-4, 10, 0), (4, 12), (0, 0, -8)), ((-4, 10, 0), (6, 9), (2, 9, 4)), ((1, 1, 0), (-1, 1), (0, 0, 0)), ((2, 3, 7), (1, 3), (3, 3, 7)),
    ],
)
def test_fill_cases(state, fill, want):
    assert R.apply_fill(*map(D, state), *map(D, fill)) == tuple(map(D, want))


def test_distributions(spark):
    import statistics

    n = statistics.NormalDist()
    xs = [v / 4 for v in range(-28, 29)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.norm_cdf("x").alias("c"), N.norm_ppf(N.norm_cdf("x")).alias("q"), N.chi2_sf(F.abs("x") * 3, 3).alias("o"), N.chi2_sf(F.abs("x") * 3, 4).alias("e")).collect()
    for r in rows:
        assert abs(r.c - n.cdf(r.x)) < 1e-11
        if abs(r.x) < 5:
            assert abs(r.q - r.x) < 1e-6
        h = abs(r.x) * 1.5
        assert abs(r.e - math.exp(-h) * (1 + h)) < 1e-12
        assert abs(r.o - (math.erfc(math.sqrt(h)) + 2 * math.sqrt(h / math.pi) * math.exp(-h))) < 1e-9
    assert spark.range(1).select(N.norm_ppf(F.lit(0.0)).alias("v")).first().v is None


def test_complexity_entropy_adf_dcor():
    assert K.phrase_count([0, 0, 0, 1]) == 2
    assert K.phrase_count([0, 1, 0, 1, 0, 1]) == 2
    assert K.phrase_count([0, 1, 2, 0, 2, 1]) == 4
    assert K.encode_quantiles(np.array([1.0, 1.0, 1.0]), 4).tolist() == [0, 0, 0]
    assert abs(K.entropy_nats(np.array([0, 1, 0, 1])) - math.log(2)) < 1e-9
    rng = np.random.default_rng(1)
    e = rng.normal(size=400)
    assert K.adf_tstat(e) < -5 < K.adf_tstat(np.cumsum(e))
    x = rng.normal(size=300)
    assert K.distance_corr(x, x) == pytest.approx(1.0)
    a = np.abs(x[:, None] - x[None, :])
    y = x**2
    b = np.abs(y[:, None] - y[None, :])
    ca = a - a.mean(0) - a.mean(1)[:, None] + a.mean()
    cb = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    assert K.distance_corr(x, y) == pytest.approx(math.sqrt((ca * cb).mean() / math.sqrt((ca * ca).mean() * (cb * cb).mean())))


def test_rolling_adf_matches_single(walk):
    pdf, df = walk
    got = K.rolling_adf(df, FR, "close", 40).toPandas().sort_values(["id", "ts"]).rolling_adf.to_numpy(dtype=float)
    y = np.log(pdf[pdf.id == 1].close.to_numpy())
    assert np.isnan(got[:40]).all()
    assert got[100] == pytest.approx(K.adf_tstat(y[61:101]), rel=1e-6)


def test_empty_and_single_rows(spark):
    one = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 1.0, 0.0)], "id int, ts int, open double, high double, low double, close double, volume double")
    for df in (one, one.filter("id < 0")):
        out = I.indicator_pack(ewm_span(df, FR, "close", {"e": 5}), FR)
        assert out.count() == df.count()
        assert A.kama(df, FR).count() == df.count()


def test_fixed_weights_of_fractional_difference():
    assert K.ffd_weights(1.0)[:2] == [1.0, -1.0]
    assert all(abs(w) >= 1e-2 for w in K.ffd_weights(0.4))
