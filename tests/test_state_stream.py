"""Incremental equals full; streams equal batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.functions.smoothing import ewm_span, span
from tideline.operators import labels as L
from tideline.plans import incremental as P
from tideline.sources import market as M
from tideline.streaming import live

FR = Frame()


@pytest.fixture(scope="module")
def ticks(spark, sf):
    return M.event_ticks(spark, sf).select("id", "ts", F.col("price")).filter("price > 0")


def stream_of(spark, df, folder, parts=3):
    df.repartition(parts).write.mode("overwrite").parquet(folder + "/in")
    return live.read_stream(spark, folder + "/in", df.schema)


def test_slices_carry_state(spark, ticks, folder):
    days = ticks.withColumn("d", F.date_trunc("day", "ts"))
    a = span(10)

    def step(part, state):
        if state is None:
            out = ewm_span(part, FR, "price", {"ema": 10})
        else:
            seen = part.join(state.select("id"), "id", "left_semi")
            fresh = part.join(state.select("id"), "id", "left_anti")
            out = P.continue_ema(seen, state.join(seen.select("id").distinct(), "id"), FR, "price", a).unionByName(ewm_span(fresh, FR, "price", {"ema": 10}))
        new = out.groupBy("id").agg(F.max("ts").alias("last_ts"), F.max_by("ema", "ts").alias("last_value"))
        return out.select("id", "ts", "price", "ema"), new if state is None else P.upsert(state, new, ["id"])

    got = P.in_slices(days.select("id", "ts", "price"), FR, ["2024-01-08", "2024-01-20"], step, folder).toPandas().sort_values(["id", "ts"])
    want = ticks.toPandas().sort_values(["id", "ts"]).groupby("id").price.transform(lambda v: v.ewm(span=10, adjust=False).mean())
    np.testing.assert_allclose(got.ema.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)


def test_dynamic_partition_overwrite(spark, folder):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    P.write_partitions(a, folder + "/t", ["p"])
    P.write_partitions(spark.createDataFrame([("y", 3)], "p string, v int"), folder + "/t", ["p"])
    assert sorted((r.p, r.v) for r in spark.read.parquet(folder + "/t").collect()) == [("x", 1), ("y", 3)]


def test_stream_ohlcv_matches_batch_on_closed_windows(spark, ticks, folder):
    s = live.ohlcv(stream_of(spark, ticks, folder), "id", "1 day", "1 hour")
    live.run_to_table(s, "bars_live", folder + "/c")
    got = spark.table("bars_live").toPandas()
    want = ticks.groupBy("id", F.date_trunc("day", "ts").alias("bar_start")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close")).toPandas()
    j = got.merge(want, on=["id", "bar_start"], suffixes=("", "_w"))
    assert len(j) == len(got) > 0
    assert (j.open == j.open_w).all() and (j.close == j.close_w).all() and (j.high == j.high_w).all() and (j.low == j.low_w).all()


def test_stream_last_prices(spark, ticks, folder):
    live.run_to_table(live.last_prices(stream_of(spark, ticks, folder), "id"), "last_live", folder + "/c", "complete")
    got = {r.id: r.price for r in spark.table("last_live").collect()}
    want = {r.id: r.p for r in ticks.groupBy("id").agg(F.max_by("price", "ts").alias("p")).collect()}
    assert got == want


def test_stream_ema_cusum_positions(spark, ticks, folder):
    live.configure(spark)
    src = stream_of(spark, ticks, folder, 1)
    live.run_to_table(live.running_ema(src, "id", span(9)), "ema_live", folder + "/c1")
    got = spark.table("ema_live").toPandas().sort_values(["key", "ts"])
    pdf = ticks.toPandas().sort_values(["id", "ts"])
    want = pdf.groupby("id").price.transform(lambda v: v.ewm(span=9, adjust=False).mean())
    np.testing.assert_allclose(got.ema, want, rtol=1e-9)

    live.run_to_table(live.running_cusum(src, "id", 1.5), "cusum_live", folder + "/c2")
    hits = spark.table("cusum_live").toPandas()
    n = sum(int(L.cusum_marks(np.concatenate([[np.nan], np.diff(np.log(g.price))]), 1.5).sum()) for _, g in pdf.groupby("id"))
    assert len(hits) == n > 0

    fills = ticks.select("id", "ts", (F.pmod(F.xxhash64("ts"), F.lit(5)) - 2).cast("double").alias("qty"), "price").filter("qty <> 0")
    fs = folder + "/f"
    live.run_to_table(live.running_positions(stream_of(spark, fills, fs, 1), "id"), "pos_live", folder + "/c3")
    from tideline.operators.risk import fold_fills

    a = spark.table("pos_live").toPandas().sort_values(["key", "ts"])
    b = fold_fills(fills, ["id"], ["ts"]).toPandas().sort_values(["id", "ts"])
    np.testing.assert_allclose(a.realized_pnl, b.realized_pnl.astype(float), rtol=1e-9, atol=1e-9)


def test_stream_stop_hits(spark, ticks, folder):
    pos = ticks.select("id").distinct().withColumns({"side": F.lit("long"), "stop_price": F.lit(1.0), "target_price": F.lit(60.0)})
    live.run_to_table(live.stop_hits(stream_of(spark, ticks, folder), pos, ["id"]), "hits_live", folder + "/c")
    assert spark.table("hits_live").count() == ticks.filter("price <= 1 OR price >= 60").count()


def test_stream_stale_keys(spark, folder):
    live.configure(spark)
    rows = [(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:00:00", 1.0), (2, "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "id long, t string, price double").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "price")
    live.run_to_table(live.stale_keys(stream_of(spark, df, folder, 1), "id", 3_600_000, "0 seconds"), "stale_live", folder + "/c")
    assert 1 in {r.key for r in spark.table("stale_live").collect()}


def _fills(spark):
    import datetime as dt
    import random

    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 7 if i % 50 else 9, start + dt.timedelta(hours=i), rng.choice([-2, -1, 1, 3]), rng.uniform(1, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, qty long, price double")
    return df, [str(start + dt.timedelta(days=d)) for d in (5, 10, 20)]


def test_fills_in_slices_equal_one_fold(spark, folder):
    """Some keys have no fills in a slice; a task streams all its keys."""
    from tideline.operators import risk as K

    df, edges = _fills(spark)
    plain = K.fold_fills(df, ["id"], ["ts"]).collect()
    assert sorted(map(tuple, K.fold_fills_in_slices(df, ["id"], ["ts"], edges, folder).collect())) == sorted(map(tuple, plain))


def test_fills_have_no_python_group_per_key(spark, monkeypatch):
    from tideline.operators import risk as K

    df, edges = _fills(spark)
    monkeypatch.setattr(P, "in_slices", lambda d, f, e, step, folder: step(d, None)[0])
    plan = K.fold_fills_in_slices(df, ["id"], ["ts"], edges, "")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan


def test_a_slice_is_computed_once(spark, folder):
    """Its state comes from the output that was written, not from a second run."""
    df, edges = _fills(spark)
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    def step(part, state):
        out = part.mapInArrow(count, part.schema)
        return out, out.groupBy("id").agg(F.max("qty").alias("qty"))

    assert P.in_slices(df, FR, edges, step, folder).count() == 600
    assert runs.value == 600
