"""Monotonicity of quintiles whose growth leaves the double range, is tied, or is missing."""

import datetime as dt
import math
import random

import duckdb
import pandas as pd
import pytest

from tests.test_ruin import agrees
from tideline.operators import research as Q


def rank_corr(spark, rows):
    p = spark.createDataFrame([(dt.date(1990, 1, 1) + dt.timedelta(i), *r) for i, r in enumerate(rows)], "ts date, " + ", ".join(f"q{i} double" for i in range(1, 6)))
    return Q.monotonicity(Q.cumulative_quintiles(p)).collect()[0].monotonicity


def test_growth_past_the_double_range_is_ranked(spark):
    rows = [(2.0, 1.5, -0.5, -0.6, -0.7)] * 1500  # e^1648, e^1374, e^-1040, e^-1374, e^-1806
    assert rank_corr(spark, rows) == pytest.approx(-1.0)


def test_ties_and_missing_growth_follow_rank(spark):
    con = duckdb.connect()
    sql = lambda x: con.execute(f"SELECT corr(pos, r) FROM (SELECT pos, rank() OVER (ORDER BY x) AS r FROM (SELECT unnest([0, 1, 2, 3, 4]) AS pos, unnest({x}) AS x))").fetchone()[0]
    assert rank_corr(spark, [(0.25, 0.25, 0.5, 0.125, 0.5)] * 3) == pytest.approx(sql([0.25, 0.25, 0.5, 0.125, 0.5]))
    for rows in ([], [(0.5,) * 5] * 2):
        assert math.isnan(rank_corr(spark, rows)) and math.isnan(sql([0.5] * 5))
    assert rank_corr(spark, [(-1.0, 0.5, -2.0, 0.25, 0.125)]) == pytest.approx(sql("[ln(x) FOR x IN [0.0, 1.5, -1.0, 1.25, 1.125]]"))


@pytest.fixture(scope="module")
def swings(spark, tmp_path_factory):
    """Ten nations over 900 days whose prices are drawn anew each day, so falls are followed by rises of several hundred percent."""
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("swings")
    rows = [(d * 10 + n, n, dt.datetime(1993, 1, 1) + dt.timedelta(d), rng.choice((1.0, 20.0)) * rng.uniform(10, 100), "1-X") for d in range(900) for n in range(10)]
    o = pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]).astype({"o_orderkey": "int64", "o_custkey": "int64"})
    o["o_orderdate"] = o.o_orderdate.astype("datetime64[us]")
    o.to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(10), "c_nationkey": pd.Series(range(10), dtype="int32")}).to_parquet(folder / "customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def test_query_matches_sql_where_growth_overflows(spark, swings):
    assert agrees(spark, swings, "research_quintile_monotonicity")
