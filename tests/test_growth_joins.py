"""Open-bar increments, the validation gauntlet, exact set joins and block searches against plain forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import bars as B
from tideline.operators import gauntlet as G
from tideline.operators import openbars as O
from tideline.operators import resample as RS
from tideline.operators import setjoin as J
from tideline.operators import stats as S
from tideline.operators import text as X
from tideline.sources import folders as FO

SPECS = [(1, "W"), (2, "W"), (1, "M"), (3, "M"), (1, "Y")]


def daily(spark, seed=4, ids=3, days=420):
    rng = random.Random(seed)
    rows = []
    for i in range(ids):
        for d in range(days):
            if rng.random() < 0.25 or (i == 2 and d < 200):
                continue
            o, c = rng.uniform(1, 9), rng.uniform(1, 9)
            rows.append((i, d, o, max(o, c) + rng.random(), min(o, c) - rng.random() / 2, c, None if rng.random() < 0.05 else float(rng.randrange(9))))
    df = spark.createDataFrame(rows, "id int, d int, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.expr("timestamp_ntz'2020-03-11 00:00:00' + make_dt_interval(d)")).drop("d").cache()


@pytest.mark.parametrize("kind", [O.COUNT, O.CALENDAR, O.ANCHORED])
def test_increments_equal_a_full_build(spark, folder, kind):
    days = daily(spark)
    bars = O.Bars(kind, [2, 5, 30] if kind == O.COUNT else SPECS)
    cuts = ["2020-01-01", "2020-03-12", "2020-03-20", "2020-07-01", "2020-07-02", "2020-12-31", "2022-01-01"]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        O.append_days(days.filter((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))), bars, folder, i)
    whole = B.count_snapshots(days, [2, 5, 30]) if kind == O.COUNT else (B.calendar_snapshots if kind == O.CALENDAR else B.anchored_snapshots)(days, SPECS, "iso")
    grown = O.finished(spark, bars, folder).select(*whole.columns)
    assert grown.exceptAll(whole).count() == 0 and whole.exceptAll(grown).count() == 0


def test_a_repeated_batch_adds_nothing(spark, folder):
    days, bars = daily(spark, ids=1, days=40), O.Bars(O.COUNT, [7])
    O.append_days(days, bars, folder, 0)
    O.append_days(days, bars, folder, 1)
    assert O.finished(spark, bars, folder).count() == days.count()
    old, new = (spark.read.parquet(f"{folder}/state/batch={i}") for i in (0, 1))
    assert old.exceptAll(new).count() == 0


def candidates(spark, n=900, ids=4):
    rng = np.random.default_rng(6)
    y = rng.normal(size=ids * n)
    cols = {"strong": y + rng.normal(size=len(y)), "noise": rng.normal(size=len(y)), "late": np.where(np.arange(len(y)) % n < 0.8 * n, y, -y) + rng.normal(size=len(y)), "against": -y + rng.normal(size=len(y))}
    rows = [(i // n, i % n, float(y[i]), *[float(c[i]) for c in cols.values()], None if i % n else 1.0) for i in range(len(y))]
    df = spark.createDataFrame(rows, f"id int, d int, y double, {', '.join(c + ' double' for c in cols)}, rare double")
    return df.withColumn("ts", F.expr("timestamp_ntz'2019-01-01 00:00:00' + make_dt_interval(d)")).drop("d"), [*cols, "rare"]


def test_candidates_leave_at_the_stage_that_fits(spark, folder):
    df, names = candidates(spark)
    got = {r.candidate: r for r in G.gauntlet(df, names, folder, perms=200).collect()}
    assert {c: r.left_at for c, r in got.items()} == {"strong": "passed_all", "noise": "fdr", "late": "held_out", "against": "cpcv", "rare": "insufficient_data"}
    assert got["late"].held_out_status == "failed_sign_flip" and got["noise"].n_paths is None and got["against"].held_out_n is None
    assert got["strong"].n_paths == 15 and abs(got["strong"].ic - 0.69) < 0.05 and got["strong"].promoted
    # only one strict survivor, none marginal: strong correlations that passed FDR come in
    assert {r.rule for r in got.values()} == {"one_strong"} and got["late"].promoted and not got["noise"].promoted
    survivors = spark.read.parquet(f"{folder}/fdr")
    plan = G.left_in(spark.read.parquet(f"{folder}/pairs"), survivors, F.col("p_adj") <= 0.05)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_shifted_products_are_permutations(spark, monkeypatch):
    x, y, key = np.arange(1.0, 8), np.arange(1.0, 8) ** 2, np.array([9, 4, 7, 1, 8, 3, 6])
    got = RS.shifted_products(x, y, key, 150)
    order = sorted(range(7), key=lambda i: (key[i] * RS.multipliers(150)[0] % RS.PRIME, i))
    assert got[3] == sum(x[k] * y[order[(k + 1 + 3 * 7 // 100) % 7]] for k in range(7)) and len(set(got)) > 1
    df, _ = candidates(spark, n=60, ids=2)
    pairs = df.select(F.lit("strong").alias("c"), F.monotonically_increasing_id().alias("row"), F.col("strong").alias("x"), "y")
    plain = RS.permutation_test(pairs, ["c"], "row", 300).first()
    monkeypatch.setattr(RS, "BLOCK", 25)
    split = RS.permutation_test(pairs, ["c"], "row", 300).first()
    assert plain.ic == split.ic and plain.n_obs == split.n_obs == 120 and plain.p_value == split.p_value == 0.0
    assert abs(plain.null_95 - split.null_95) < 0.06 and abs(plain.null_95 - 1.96 / 119**0.5) < 0.05


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_set_join_is_complete(spark, monkeypatch, threshold):
    monkeypatch.setattr(J, "BLOCK", 5)
    rng = random.Random(8)
    sets = []
    for i in range(160):
        base = set(rng.sample(range(40), rng.randrange(1, 12))) if i % 4 == 0 or not sets else set(rng.choice(sets))
        for _ in range(rng.randrange(3)):
            base ^= {rng.randrange(60)}
        sets.append(base or {1})
    df = spark.createDataFrame([(i, [int(t) for t in s]) for i, s in enumerate(sets)], "id long, tokens array<long>")
    want = {(i, j) for j in range(160) for i in range(j) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    found = J.similar_sets(df, threshold).collect()
    assert {(r.id_a, r.id_b) for r in found} == want and len(found) == len(want) > 10
    assert J.candidates(df, threshold).count() < 160 * 159 / 4


def test_short_texts_copies_and_nulls_have_classes(spark):
    rows = [(1, "Yes"), (2, " yes "), (3, "no"), (4, None), (5, ""), (6, "  "), (7, "a b c d e f g h i j"), (8, "a b c d e f g h i k"), (9, "a b c d e f g h i")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in X.duplicate_classes(df).collect()}
    assert [got[i].rep_id for i in range(1, 10)] == [1, 1, 3, 4, 5, 5, 7, 8, 9]
    assert [got[i].class_id for i in (7, 8, 9)] == [7, 7, 7] and got[4].copies == 1 and got[2].copies == 2 and got[9].n_links == 2
    assert got[7].best_tier == "very_similar" and got[3].best_tier is None and got[3].class_id == 3


def test_block_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(300, 8)), 1)
    m[7] = m[100] = m[9]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "vec_id int, embedding array<double>")
    q = df.filter("vec_id < 40 OR vec_id = 999").select(F.col("vec_id").alias("query_id"), "embedding")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u[:40] @ u.T, 9)
    want = {(i, j, k + 1) for i in range(40) for k, j in enumerate(sorted((j for j in range(300) if s[i, j] >= 0.2), key=lambda j: (-s[i, j], j))[:6])}
    for sizes in ((1024, 16_384), (7, 50)):
        got = X.top_matches(q, df, 6, 0.2, max_queries=sizes[0], max_vectors=sizes[1]).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want
    plan = X.top_matches(q, df, 6)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert X.top_matches(q.limit(0), df, 6).count() == 0 == X.top_matches(q, df.filter("false"), 6).count()


def test_bootstrap_equals_plain_resampling():
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=60), 1), np.round(rng.normal(size=60), 1)
    got = RS.bootstrap_correlations(x, y, 25, 7.0, 3, cells=200)
    picks = RS.stationary_picks(60, np.arange(25), 7.0, 3)
    want = [pd.Series(x[p]).rank().corr(pd.Series(y[p]).rank()) for p in picks]
    assert np.allclose(got, want) and len(set(got)) == 25
    runs = (np.diff(RS.stationary_picks(4000, np.arange(5), 10.0, 3), axis=1) % 4000 != 1).mean()
    assert 0.08 < runs < 0.12  # runs of ten rows on average


def test_closed_lots_of_a_plain_queue(spark):
    rng = random.Random(9)
    fills = [(k, i, rng.choice([-5, -2, -1, 1, 2, 40]), float(rng.randrange(5, 20))) for k in range(3) for i in range(120)]
    want = []
    for k in range(3):
        lots = []
        for n, (_, _, q, p) in enumerate((f for f in fills if f[0] == k), 1):
            while q and lots and lots[0][0] * q < 0:
                m = min(abs(q), abs(lots[0][0]))
                side = 1 if lots[0][0] > 0 else -1
                want.append((k, lots[0][2], n, float(m), round(side * (p / lots[0][1] - 1), 9)))
                lots[0][0] -= side * m
                q += side * m
                if not lots[0][0]:
                    lots.pop(0)
            if q:
                lots.append([q, p, n])
    df = spark.createDataFrame(fills, "id int, ts int, qty int, price double")
    for rows in (65_536, 7):
        got = S.round_trips(df, ["id"], ["ts"], F.floor(F.col("ts") / 10), rows).collect()
        assert sorted((r.id, r.entry_n, r.exit_n, r.qty, round(r.ret, 9)) for r in got) == sorted(want)


def test_dropout_in_slices_equals_one_fold(spark, folder):
    rng = random.Random(2)
    rows = [(p, d, i, None if rng.random() < 0.1 else rng.random()) for p in (1, 2, 3) for d in range(40) for i in range(12) if not (p == 2 and 10 < d < 30) and rng.random() < 0.9]
    df = spark.createDataFrame(rows, "portfolio int, d int, id int, score double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d)")).drop("d")
    whole = {tuple(r) for r in S.topk_dropout(df, ["portfolio"], "ts", 4, 1).collect()}
    cut = {tuple(r) for r in S.topk_dropout(df, ["portfolio"], "ts", 4, 1, ["2024-01-05", "2024-01-15", "2024-01-25"], folder).select("portfolio", "ts", "id", "action").collect()}
    assert whole == cut and len(whole) > 300


def test_folder_loads_are_repeatable(spark, folder):
    source, target = f"{folder}/in", f"{folder}/out"

    def deliver(rows):
        spark.createDataFrame(rows, "name string, ts int, v double").coalesce(1).write.mode("append").option("header", True).csv(source)

    def read(paths):
        d = spark.read.schema("name string, ts int, v double").option("header", True).csv(paths)
        return d.select(F.when(F.col("name") != "?", F.col("name")).alias("k"), "ts", "v", F.col("_metadata.file_path").alias("source_file"))

    def load(**kw):
        return sorted((r.rows, r.rows_loaded, r.resolved) for r in FO.load_folder(spark, source, target, read, "k", "ts", ["v"], **kw).collect())

    table = lambda: {(r.k, r.ts): r.v for r in spark.read.parquet(f"{target}/data").collect()}
    deliver([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)])
    assert load() == [(3, 3, True)] and load() == []
    deliver([("a", 2, 9.0), ("a", 3, 3.0)])
    deliver([("?", 1, 0.0)])
    assert load() == [(1, 0, False), (2, 1, True)]
    assert table() == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 3.0, ("b", 1): 5.0}
    assert load() == [(1, 0, False)]  # only the file that can't be resolved is asked for again
    spark.createDataFrame([], FO.FILE).write.mode("overwrite").parquet(f"{target}/manifest")  # as after a load that was cut off
    assert load() == [(1, 0, False), (2, 0, True), (3, 0, True)] and table()["a", 2] == 2.0
    spark.createDataFrame([], FO.FILE).write.mode("overwrite").parquet(f"{target}/manifest")
    assert load(full=True) == [(1, 0, False), (2, 2, True), (3, 3, True)] and table() == {("a", 1): 1.0, ("a", 2): 9.0, ("a", 3): 3.0, ("b", 1): 5.0}
