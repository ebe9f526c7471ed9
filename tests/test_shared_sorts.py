"""Smoothing of several rates of one input needs two sorts in all, and gives the plain recursion."""

import random

import pytest

from tideline.functions.frames import Frame
from tideline.operators import averages as A
from tideline.operators import indicators as I


def series(spark, keys=3, n=400):
    rng = random.Random(4)
    rows = [(k, t, None if rng.random() < 0.1 else rng.uniform(50, 150)) for k in range(keys) for t in range(n + 40 * k)]
    return spark.createDataFrame(rows, "id int, ts int, close double")


def sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Sort [")


def test_few_sorts(spark):
    df = series(spark)
    assert sorts(A.add_emas(df, Frame(), periods=(9, 21, 50))) <= 2
    assert sorts(I.macd(df, Frame())) <= 2
    assert sorts(I.rsi(df, Frame(), (14, 7))) <= 2


def test_emas_equal_the_recursion(spark):
    got = {(r.id, r.ts): r for r in A.add_emas(series(spark), Frame(), periods=(3, 9, 21)).collect()}
    by = {}
    for r in sorted(got.values(), key=lambda r: (r.id, r.ts)):
        by.setdefault(r.id, []).append(r)
    for rows in by.values():
        for p in (3, 9, 21):
            last, run = None, []
            for r in rows:
                run = [] if r.close is None else [*run, r.close][-p:]
                if last is None:
                    last = sum(run) / p if len(run) == p else None
                elif r.close is not None:
                    last += 2.0 / (p + 1) * (r.close - last)
                assert r[f"close_ema_{p}"] == (None if last is None else pytest.approx(last, rel=1e-12))


def test_rsi_of_two_lengths_equals_one_by_one(spark):
    df = series(spark)
    both = I.rsi(df, Frame(), (14, 7)).orderBy("id", "ts").collect()
    one = I.rsi(I.rsi(df, Frame(), 14), Frame(), 7).orderBy("id", "ts").collect()
    for a, b in zip(both, one):
        for c in ("rsi_14", "rsi_7"):
            assert a[c] == (None if b[c] is None else pytest.approx(b[c], rel=1e-9))
