"""A gauntlet of validation stages for candidate features: permutation, FDR, combinatorial folds, held-out rows.

Every stage costs more than the one before and is asked only for what is left: pairs lie in a table that is partitioned by candidate, each
stage writes a table of its statistics, and the next one joins the pairs with the survivors of that table, so the scan prunes the
partitions of candidates that have left.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.operators.asof import safe_corr
from tideline.operators.evaluate import fold_of
from tideline.operators.research import fdr
from tideline.operators.resample import permutation_test
from tideline.plans.segments import group_rank, number_rows

def pool(df: DataFrame, candidates: Sequence[str], y: str = "y", held_out: float = 0.2) -> DataFrame:
    """candidate, part, id, ts, pos, n, x, y: usable pairs of each candidate over all ids that have it in half of their training rows.

    The first rows of every id are its training part. Training pairs are numbered by id and time; numbers come from counts for each id.
    """
    per_id = number_rows(df.select("id", "ts", y, *candidates), Frame(("id",), ("ts",)), F.year("ts"), "_k")
    size = per_id.groupBy("id").agg(F.count("*").alias("_n"))
    items = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias("x")) for c in candidates])
    cut = F.floor(F.col("_n") * F.lit(1.0 - held_out))
    tall = per_id.join(size, "id").select("id", "ts", F.col(y).alias("y"), F.when(F.col("_k") <= cut, "train").otherwise("held_out").alias("part"), F.explode(items).alias("_i"))
    tall = tall.select("id", "ts", "y", "part", "_i.*")
    train = F.col("part") == "train"
    good = tall.groupBy("candidate", "id").agg(F.count(F.when(train, F.col("x"))).alias("_have"), F.count(F.when(train, 1)).alias("_of"))
    good = good.filter((F.col("_have") > 0) & (F.col("_have") >= 0.5 * F.col("_of"))).select("candidate", "id")
    d = tall.join(good, ["candidate", "id"]).filter("x IS NOT NULL AND y IS NOT NULL")
    return number_rows(d, Frame(("candidate", "part"), ("id", "ts")), F.col("id"), "pos")


def fold_paths(pairs: DataFrame, splits: int = 6, tests: int = 2, min_rows: int = 10, min_pairs: int = 30) -> DataFrame:
    """candidate, n_paths, cpcv_mean, cpcv_std, cpcv_positive, cpcv_passed over all choices of ``tests`` of ``splits`` folds."""
    n = pairs.groupBy("candidate").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pairs)
    choices = list(combinations(range(splits), tests))
    mine = F.array(*[F.array(*[F.lit(i) for i, c in enumerate(choices) if k in c]) for k in range(splits)])
    d = pairs.join(n, "candidate").withColumn("path", F.explode(F.get(mine, fold_of("pos", "_n", splits).cast("int"))))
    by = ["candidate", "path"]
    d = group_rank(d.select(*by, "x", "y"), by, "x").withColumnRenamed("rank_avg", "rx").drop("rank_min", "group_n")
    d = group_rank(d, by, "y").withColumnRenamed("rank_avg", "ry")
    paths = d.groupBy(*by).agg(safe_corr("rx", "ry").alias("c"), F.count("*").alias("_k")).filter((F.col("_k") >= min_rows) & F.col("c").isNotNull())
    g = paths.groupBy("candidate").agg(F.count("*").alias("n_paths"), F.avg("c").alias("cpcv_mean"), F.stddev_pop("c").alias("cpcv_std"), F.avg((F.col("c") > 0).cast("double")).alias("cpcv_positive"))
    enough = F.col("n_paths") >= 2
    g = g.withColumns({c: F.when(enough, F.col(c)) for c in ("cpcv_mean", "cpcv_std", "cpcv_positive")})
    return g.withColumn("cpcv_passed", F.coalesce((F.col("cpcv_mean") > 0) & (F.col("cpcv_positive") > 0.6), F.lit(False)))


def held_out_test(pairs: DataFrame, floor: float = 0.01, min_obs: int = 20) -> DataFrame:
    """candidate, held_out_n, held_out_ic, held_out_status. ``pairs`` carries the training ``ic``."""
    d = group_rank(pairs, ["candidate"], "x").withColumnRenamed("rank_avg", "rx").drop("rank_min", "group_n")
    d = group_rank(d, ["candidate"], "y").withColumnRenamed("rank_avg", "ry")
    g = d.groupBy("candidate").agg(F.count("*").alias("held_out_n"), safe_corr("rx", "ry").alias("c"), F.first("ic").alias("ic"))
    c = F.when(F.col("held_out_n") >= min_obs, F.col("c"))
    same = F.coalesce(F.signum("held_out_ic") == F.signum("ic"), F.lit(False))
    status = F.when(F.col("held_out_n") < min_obs, "insufficient").when(~same, "failed_sign_flip").when(F.abs("held_out_ic") < floor, "marginal").otherwise("passed")
    return g.withColumn("held_out_ic", c).withColumn("held_out_status", status).drop("c", "ic")


def gauntlet(df: DataFrame, candidates: Sequence[str], folder: str, *, y: str = "y", held_out: float = 0.2, perms: int = 1000, alpha: float = 0.05, min_pairs: int = 100, splits: int = 6, tests: int = 2, floor: float = 0.01) -> DataFrame:
    """One row for each candidate: the statistics of the stages it reached, ``left_at`` and ``promoted``.

    ``df``: id, ts, ``y`` (what is to be predicted) and the candidates' columns. ``folder``: a shared folder for the stage tables. A candidate
    with fewer than ``min_pairs`` training pairs is insufficient and counts as p = 1 in the family. With fewer than two strict survivors
    marginal held-out results (right sign, below ``floor``) are promoted too; if these are fewer than two as well, strict survivors and
    those that passed FDR with |IC| > 0.03 at p < 0.01 are. Runs one write for each stage while it is called.
    """
    spark = df.sparkSession

    def stage(out: DataFrame, name: str, *parts: str) -> DataFrame:
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    pairs = stage(pool(df, candidates, y, held_out), "pairs", "part", "candidate")
    train, rest = pairs.filter("part = 'train'"), pairs.filter("part = 'held_out'")
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, candidates))).alias("candidate"))
    counts = train.groupBy("candidate").agg(F.count("*").alias("_n"))
    known = every.join(counts, "candidate", "left").select("candidate", F.coalesce("_n", F.lit(0)).alias("n_pairs"))
    known = stage(known.withColumn("enough", F.col("n_pairs") >= min_pairs), "candidates")
    tested = permutation_test(left_in(train, known, F.col("n_pairs") >= min_pairs), ["candidate"], "pos", perms)
    one = known.join(tested, "candidate", "left").withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    one = stage(one.withColumn("permutation_passed", F.coalesce(F.abs("ic") >= F.col("null_95"), F.lit(False))), "permutation")
    two = stage(fdr(one, alpha=alpha).withColumn("fdr_passed", F.col("significant") & F.col("enough")).drop("significant"), "fdr")
    three = stage(fold_paths(left_in(train, two, F.col("enough") & (F.col("p_adj") <= alpha)), splits, tests), "cpcv")
    survivors = two.select("candidate", "ic").join(three.filter(F.col("cpcv_passed") & (F.col("cpcv_positive") > 0.6)).select("candidate"), "candidate")
    four = stage(held_out_test(rest.join(survivors, "candidate"), floor), "held_out")
    d = two.join(three, "candidate", "left").join(four, "candidate", "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("cpcv_passed",)})
    strict = F.coalesce(F.col("held_out_status") == "passed", F.lit(False))
    marginal = F.coalesce(F.col("held_out_status") == "marginal", F.lit(False))
    strong = F.col("fdr_passed") & (F.abs("ic") > 0.03) & (F.col("p_value") < 0.01)
    totals = d.agg(F.count_if(strict).alias("_strict"), F.count_if(strict | marginal).alias("_loose"))
    d = d.crossJoin(F.broadcast(totals))  # one row
    rule = F.when(F.col("_strict") >= 2, "strict").when(F.col("_loose") >= 2, "same_sign").otherwise("one_strong")
    kept = F.when(F.col("_strict") >= 2, strict).when(F.col("_loose") >= 2, strict | marginal).otherwise(strict | strong)
    left = F.when(~F.col("enough"), "insufficient_data").when(~F.col("fdr_passed"), "fdr").when(~F.col("cpcv_passed"), "cpcv").when(~strict, "held_out").otherwise("passed_all")
    return d.withColumns({"left_at": left, "promoted": kept, "rule": rule}).drop("_strict", "_loose", "enough")


def left_in(pairs: DataFrame, stage: DataFrame, passed: Column) -> DataFrame:
    """Pairs of the candidates that a stage table lets through. ``passed`` should compare a stored statistic: that is what the optimizer
    takes for selective (a stored flag is not), and then it prunes the partitions of the pairs."""
    return pairs.join(stage.filter(passed).select("candidate"), "candidate")
