"""Differences of adaptive averages within and across open and finished bars."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.operators import averages as A


def test_roll_differences_and_returns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, tf, d, float(rng.uniform(5, 9)), [None, True, False][int(rng.integers(3))]) for i in (1, 2) for tf in ("2D", "7D") for d in range(60)]
    df = spark.createDataFrame(rows, "id int, tf string, d int, close double, roll boolean").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d)"))
    got = A.adaptive_timeframes(df, Frame(("id", "tf")), roll="roll", linear=(9,)).toPandas()
    assert not got.roll.isna().any()
    keys = ["id", "tf", "indicator", "params_hash"]
    got = got.sort_values([*keys, "ts"]).reset_index(drop=True)
    got = got.astype({c: float for c in ("value", "d1", "d2", "d1_roll", "d2_roll", "ret_arith", "ret_log")})
    same = lambda s: s.groupby([got[k] for k in (*keys, "roll")])
    every = lambda s: s.groupby([got[k] for k in keys])
    want = {"d1": same(got.value).diff(), "d1_roll": every(got.value).diff(), "ret_arith": got.value / same(got.value).shift() - 1}
    want |= {"d2": same(want["d1"]).diff(), "d2_roll": every(want["d1_roll"]).diff(), "ret_log": np.log(got.value / same(got.value).shift())}
    for name, values in want.items():
        pd.testing.assert_series_equal(got[name], values, check_names=False, rtol=1e-9, atol=1e-9)
    assert got.d1.notna().sum() > 100 and not np.allclose(got.d1.fillna(0), got.d1_roll.fillna(0))


def test_one_exchange_by_key_and_timeframe(spark):
    df = spark.createDataFrame([(1, "2D", 1.0)], "id int, tf string, close double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = A.adaptive_timeframes(df, Frame(("id", "tf")), linear=(9,))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert out.count() == len(A.KAMA_SETS) + 3
