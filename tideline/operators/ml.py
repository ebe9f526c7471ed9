"""Model-based research on Spark ML: meta-labels, importance, per-regime models, ensembles.

Loops run over folds, features or regimes (a few), never over rows; every fit is a distributed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Frame, div
from tideline.session import checkpoint_dir


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint the feature rows once: the fits and scores below read them many times."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight column n / (classes x count of the label)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = c.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(c.crossJoin(F.broadcast(t)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).select(label, "weight")), label)


def fit_meta(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 20, depth: int = 4, seed: int = 1):
    """Random forest on balanced labels."""
    train = assemble(balanced(df, label), features)
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(train)


def with_probability(model, df: DataFrame, features: Sequence[str], out: str = "prob") -> DataFrame:
    p = model.transform(assemble(df, features)).withColumn(out, vector_to_array("probability")[1])
    return p.drop("features", "rawPrediction", "probability", "prediction")


def classifier_report(scored: DataFrame, label: str = "label", prob: str = "prob", cut: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, F1 with the filter, and the hit rate without it."""
    p, y = F.col(prob) >= cut, F.col(label) == 1
    g = scored.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.avg(y.cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n"))
    g = g.withColumns({"precision": div("tp", F.col("tp") + F.col("fp")), "recall": div("tp", F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(scored: DataFrame, label: str = "label", prob: str = "prob") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=prob).evaluate(scored)


def logit_weights(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Standardised logistic weights ordered by size (one row per feature)."""
    d = assemble(df, features)
    d = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(d).transform(d)
    m = LogisticRegression(labelCol=label, featuresCol="scaled", maxIter=50, regParam=1e-4, standardization=False).fit(d)
    rows = [(f, float(w)) for f, w in zip(features, m.coefficients.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, weight double").withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("weight")))))


def log_loss(label: str = "label", prob: str = "prob") -> Column:
    p = F.least(F.greatest(F.col(prob), F.lit(1e-12)), F.lit(1 - 1e-12))
    return -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))


def permuted(df: DataFrame, cols: Sequence[str], seed: int) -> DataFrame:
    """Swap the values of some columns between rows by a seeded pairing.

    Rows are numbered inside hash slices (each slice a small share of the rows) in two different seeded
    orders and joined on (slice, number), so no global sort or single task is needed.
    """
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    d = df.withColumn("_h", row).withColumn("_sl", F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(256)))
    a = d.withColumn("_n", F.row_number().over(Window.partitionBy("_sl").orderBy(F.xxhash64("_h", F.lit(seed + 1)), "_h")))
    b = d.select("_sl", *[F.col(c).alias(f"_p_{c}") for c in cols], F.row_number().over(Window.partitionBy("_sl").orderBy(F.xxhash64("_h", F.lit(seed + 2)), "_h")).alias("_n"))
    j = a.join(b, ["_sl", "_n"])
    return j.withColumns({c: F.col(f"_p_{c}") for c in cols}).select(*df.columns)


def importance(df: DataFrame, features: Sequence[str], groups: Sequence[Sequence[str]], label: str = "label", fold: str = "fold", role: str = "role", folds: int = 3, seed: int = 5, trees: int = 20, depth: int = 3) -> DataFrame:
    """Loss of shuffling each feature group over purged folds (single features = MDA, clusters = clustered MDA).

    ``df`` holds one row per (row, test fold) with its role; a fold is fitted once and scored once per
    group, all scores of a fold in one union.
    """
    out: DataFrame | None = None
    df = settled(df)
    for k in range(folds):
        part = df.filter(F.col("test_fold") == k)
        model = fit_meta(part.filter(F.col(role) == "train"), features, label, trees=trees, depth=depth, seed=seed)
        test = part.filter(F.col(role) == "test").select(label, *features)
        variants = [("base", test)] + [("+".join(g), permuted(test, g, seed + 7 * i)) for i, g in enumerate(groups)]
        for name, v in variants:
            s = with_probability(model, v, features).agg(log_loss(label).alias("loss")).withColumns({"feature": F.lit(name), "fold": F.lit(k)})
            out = s if out is None else out.unionByName(s)
    assert out is not None
    base = out.filter("feature = 'base'").select("fold", F.col("loss").alias("_b"))
    g = out.filter("feature <> 'base'").join(base, "fold").withColumn("_d", F.col("loss") - F.col("_b"))
    return g.groupBy("feature").agg(F.avg("_d").alias("importance"), F.stddev_samp("_d").alias("spread"), F.count(F.lit(1)).alias("n_folds"))


def single_feature(df: DataFrame, features: Sequence[str], label: str = "label", role: str = "role", folds: int = 3, seed: int = 5, trees: int = 20, depth: int = 3) -> DataFrame:
    """Test loss of one-feature models per purged fold."""
    out: DataFrame | None = None
    df = settled(df)
    for f in features:
        for k in range(folds):
            part = df.filter(F.col("test_fold") == k)
            m = fit_meta(part.filter(F.col(role) == "train"), [f], label, trees=trees, depth=depth, seed=seed)
            s = with_probability(m, part.filter(F.col(role) == "test").select(label, f), [f]).agg(log_loss(label).alias("loss")).withColumn("feature", F.lit(f))
            out = s if out is None else out.unionByName(s)
    assert out is not None
    return out.groupBy("feature").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_folds"))


def by_regime_models(train: DataFrame, test: DataFrame, features: Sequence[str], regime: str, label: str = "label", min_rows: int = 100, most: int = 200) -> DataFrame:
    """One model for each regime of the training data, the global one for rows of a regime with fewer than ``min_rows``
    training rows or of none; column ``model`` says which served a row. More than ``most`` regimes raise an error. A fit:
    runs Spark jobs while it is called."""
    train, test = settled(train), settled(test)
    counts = {r[regime]: r["n"] for r in train.filter(F.col(regime).isNotNull()).groupBy(regime).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} regimes")
    fallback = fit_meta(train, features, label)
    used = sorted((r for r, n in counts.items() if n >= min_rows), key=str)
    out = with_probability(fallback, test.filter(~F.col(regime).isin(used) | F.col(regime).isNull()), features).withColumn("model", F.lit("global"))
    for r in used:
        m = fit_meta(train.filter(F.col(regime) == r), features, label)
        out = out.unionByName(with_probability(m, test.filter(F.col(regime) == r), features).withColumn("model", F.lit(str(r))))
    return out


def rank_cross_validate(df: DataFrame, features: Sequence[str], target: str, folds: int = 3, ts: str = "ts", role: str = "role", iterations: int = 20, depth: int = 3) -> DataFrame:
    """Gradient-boosted ranker over purged folds: per-date IC and NDCG, then IC-IR per fold."""
    from tideline.operators.research import ndcg, spearman_windows

    out: DataFrame | None = None
    df = settled(df)
    for k in range(folds):
        part = df.filter(F.col("test_fold") == k)
        m = GBTRegressor(labelCol=target, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=1).fit(assemble(part.filter(F.col(role) == "train"), features))
        s = m.transform(assemble(part.filter(F.col(role) == "test"), features)).select("id", ts, target, F.col("prediction").alias("score"))
        ic = spearman_windows(s, [ts], "score", target, 5).select(ts, "ic")
        g = ic.join(ndcg(s, [ts], "score", target), ts).agg(F.avg("ic").alias("ic_mean"), div(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), F.avg("ndcg").alias("ndcg")).withColumn("fold", F.lit(k))
        out = g if out is None else out.unionByName(g)
    assert out is not None
    return out


def double_ensemble(df: DataFrame, features: Sequence[str], target: str, f: Frame, windows: int = 2, rounds: int = 2) -> DataFrame:
    """Mean prediction of boosted models over sliding windows; each round up-weights rows with large errors."""
    from tideline.operators.evaluate import with_folds

    d = with_folds(df.dropna(subset=[*features, target]), f, windows + 1)
    base = settled(assemble(d, features))
    preds: list[str] = []
    for w in range(windows):
        train = base.filter(F.col("fold").isin(w, w + 1)).withColumn("weight", F.lit(1.0))
        for r in range(rounds):
            m = GBTRegressor(labelCol=target, featuresCol="features", weightCol="weight", maxIter=4, maxDepth=3, seed=r + 1).fit(train)
            name = f"_p{w}_{r}"
            base = m.transform(base).withColumnRenamed("prediction", name)
            preds.append(name)
            err = m.transform(train.drop("prediction") if "prediction" in train.columns else train)
            stats = err.agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("_m"))
            train = err.crossJoin(F.broadcast(stats)).withColumn("weight", F.least(F.col("weight") * (0.5 + F.abs(F.col(target) - F.col("prediction")) / F.col("_m")), F.lit(4.0))).drop("prediction", "_m")
    avg = sum((F.col(p) for p in preds), F.lit(0.0)) / len(preds)
    return base.withColumn("score", avg).drop("features", *preds)
