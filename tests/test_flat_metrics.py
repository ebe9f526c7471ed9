"""Rankings where a metric is the same for all rows, or a probability vanishes, against their SQL."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_ruin import agrees
from tideline.operators import evaluate as E


@pytest.fixture(scope="module")
def shorts(spark, tmp_path_factory):
    """Nine nations that are always short while prices rise: turnover is flat, and every probability of a Sharpe above 0 is below that of -8."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("shorts")
    orders = []
    for nation in range(9):
        price = 100.0
        for k in range(120):
            price *= 1 + 0.02 * (1 + nation / 9) + 0.004 * rng.random()
            orders += [(len(orders) + i + 1, nation + 1, dt.date(1996, 1, 2) + dt.timedelta(k), price * (1.01 if i == 0 else 1.0), "1-X") for i in range(3)]
    o = pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]).astype({"o_orderkey": "int64", "o_custkey": "int64"})
    o["o_orderdate"] = pd.to_datetime(o.o_orderdate).astype("datetime64[us]")
    o.to_parquet(folder / "orders.parquet")
    pd.DataFrame({"c_custkey": range(1, 10), "c_nationkey": pd.Series(range(9), dtype="int32")}).to_parquet(folder / "customer.parquet")
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ("eval_composite_rank", "eval_select_distinct", "eval_rank_sensitivity"))
def test_flat_metrics_match_sql(spark, shorts, name):
    assert agrees(spark, shorts, name)


def test_what_flat_and_missing_metrics_count(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5), (2, 4.0, 0.5), (3, None, 0.5)], "id int, a double, b double")
    score = lambda **kw: [r.composite_score for r in E.composite_score(df, {"a": 0.5, "b": 0.5}, (), **kw).orderBy("id").collect()]
    assert score() == [0.5, 1.0, 0.5] and score(flat=0.0, missing=None) == [0.0, 0.5, None]
    one = E.select_distinct(df.withColumns({"g": F.lit(1), "fam": F.lit(0)}), ["g"], "fam", "b", tie=("id",)).collect()
    assert [(r.id, r.pick) for r in one] == [(1, 1)]
