"""State tables, watermarks, upserts and incremental refresh.

A refresh is: read the state, pick the keys and the window that are dirty, compute, merge by key, write
the new state. Merges rewrite only the partitions that hold touched rows (dynamic overwrite).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Col, Frame, col

Step = Callable[[DataFrame], DataFrame]


# --- state -----------------------------------------------------------------------------------------
def state_from(table: DataFrame, keys: Sequence[str], ts: str = "ts", canonical: Col | None = None, values: Sequence[str] = ()) -> DataFrame:
    """Per key: first and last timestamp, last canonical timestamp, row count and last values."""
    ok = F.lit(True) if canonical is None else col(canonical)
    last = [F.max_by(v, F.when(ok, F.col(ts))).alias(f"last_{v}") for v in values]
    return table.groupBy(*keys).agg(
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.max(F.when(ok, F.col(ts))).alias("last_canonical_ts"), F.count(F.lit(1)).alias("n_rows"), *last)


def dirty_starts(state: DataFrame, ids: DataFrame, key: str, default: Column, ts: str = "last_canonical_ts") -> DataFrame:
    """Earliest restart time of each id over its state rows; the default for an id without state."""
    m = state.groupBy(key).agg(F.min(ts).alias("_m"))
    return ids.select(key).distinct().join(m, key, "left").select(key, F.coalesce("_m", default).alias("dirty_from"))


def changed_keys(source: DataFrame, state: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Keys whose source is newer than their state, or that have none."""
    s = source.groupBy(*keys).agg(F.max(ts).alias("source_ts"))
    j = s.join(state.select(*keys, F.col("max_ts").alias("state_ts")), list(keys), "left")
    return j.filter(F.col("state_ts").isNull() | (F.col("state_ts") < F.col("source_ts")))


def up_to_date(source: DataFrame, state: DataFrame, by: Sequence[str], scope: Sequence[str], ts: str = "ts") -> DataFrame:
    """Per id: are all of its scopes current?"""
    s = source.groupBy(*by, *scope).agg(F.max(ts).alias("_src"))
    j = s.join(state.select(*by, *scope, F.col("max_ts").alias("_st")), [*by, *scope], "left")
    return j.groupBy(*by).agg(F.min(F.coalesce(F.col("_st") >= F.col("_src"), F.lit(False))).alias("is_current"), F.count(F.lit(1)).alias("n_scopes"))


def backfilled_keys(source: DataFrame, state: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Keys whose source now starts before the stored start: rebuild them whole."""
    s = source.groupBy(*keys).agg(F.min(ts).alias("source_min"))
    return s.join(state.select(*keys, "min_ts"), list(keys)).filter(F.col("source_min") < F.col("min_ts"))


def recent(state: DataFrame, keys: Sequence[str], as_of: Column, days: int) -> DataFrame:
    """Are all watermarks of the key newer than ``days`` days?"""
    return state.groupBy(*keys).agg((F.datediff(as_of, F.min("max_ts")) <= days).alias("is_recent"), F.min("max_ts").alias("oldest"))


def compute_window(source: DataFrame, state: DataFrame, warmup_days: int, ts: str = "ts") -> DataFrame:
    """One row: start = oldest watermark less the warm-up, end = newest source row."""
    a = state.agg(F.min("max_ts").alias("_w"))
    b = source.agg(F.max(ts).alias("window_end"))
    return a.crossJoin(F.broadcast(b)).select((F.col("_w") - F.make_dt_interval(days=F.lit(warmup_days))).alias("window_start"), "window_end")


def stale_sources(source: DataFrame, keys: Sequence[str], as_of: Column, hours: float, ts: str = "ts") -> DataFrame:
    g = source.groupBy(*keys).agg(F.max(ts).alias("max_ts"))
    age = F.timestamp_diff("SECOND", F.col("max_ts"), as_of) / 3600.0
    return g.withColumn("age_hours", age).withColumn("is_stale", F.col("age_hours") > hours)


def seed_watermarks(config: DataFrame, signals: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    m = signals.groupBy(key).agg(F.max(ts).alias("_m"))
    return config.join(m, key, "left").withColumn("watermark", F.coalesce("watermark", "_m")).drop("_m")


def unprocessed(signals: DataFrame, watermarks: DataFrame, done: DataFrame, key: str, row_key: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows after their watermark that are not in the processed log."""
    j = signals.join(watermarks.select(key, "watermark"), key, "left").filter(F.col("watermark").isNull() | (F.col(ts) > F.col("watermark"))).drop("watermark")
    return j.join(done.select(*row_key), list(row_key), "left_anti")


def open_positions(records: DataFrame, keys: Sequence[str], state: str = "state", ts: str = "entry_ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return records.filter(F.col(state) == "open").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# --- merges ----------------------------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conflict = skip: only rows of ``new`` whose key is absent."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Delete every old row of a scope present in ``new``, then insert ``new``."""
    return old.join(new.select(*scope).distinct(), list(scope), "left_anti").unionByName(new, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in the frame."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def refresh(source: DataFrame, target: DataFrame, keys: Sequence[str], compute: Step, warmup_rows: int, ts: str = "ts") -> DataFrame:
    """Result of a full rebuild, computed incrementally for a bounded-lookback operator.

    Per key: rows at or before the target's last row are kept; newer rows are computed with
    ``warmup_rows`` rows before them; a key whose source was backfilled is rebuilt whole.
    """
    keys = list(keys)
    state = state_from(target, keys, ts)
    back = backfilled_keys(source, state, keys, ts).select(*keys, F.lit(True).alias("_back"))
    src = source.join(state.select(*keys, F.col("max_ts").alias("_st")), keys, "left").join(back, keys, "left")
    src = src.withColumn("_st", F.when(F.col("_back"), F.lit(None)).otherwise(F.col("_st")))
    f = Frame(keys, (ts,))
    src = src.withColumn("_new", F.col("_st").isNull() | (F.col(ts) > F.col("_st")))
    near = F.coalesce(F.max(F.col("_new").cast("int")).over(f.next_rows(warmup_rows)), F.lit(0)) == 1
    work = src.withColumn("_need", F.col("_new") | near).filter("_need")
    fresh = compute(work.drop("_st", "_back", "_need")).filter("_new").drop("_new")
    kept = target.join(back.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*target.columns))


def sync_variants(tables: dict[str, DataFrame], unified: DataFrame, ts: str = "ts", tag: str = "alignment_source") -> DataFrame:
    """Rows of each variant newer than what the unified table already has of it."""
    marks = unified.groupBy(tag).agg(F.max(ts).alias("_wm"))
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return everything.join(F.broadcast(marks), tag, "left").filter(F.col("_wm").isNull() | (F.col(ts) > F.col("_wm"))).drop("_wm")


# --- recursion continued from state ----------------------------------------------------------------
def continue_ema(new_rows: DataFrame, last: DataFrame, frame: Frame, x: str, alpha: float, out: str = "ema") -> DataFrame:
    """Continue an EMA from the stored last value: the stored value is row zero of each key.

    The first new row is a*x + (1-a)*stored, which is the plain recursion with the stored value as seed.
    """
    from tideline.functions.smoothing import ewm_mean

    ts = frame.order[0]
    seed = last.select(*frame.keys, F.col("last_ts").alias(ts), F.col("last_value").alias(x), F.lit(True).alias("_seed"))
    both = new_rows.withColumn("_seed", F.lit(False)).unionByName(seed, allowMissingColumns=True)
    return ewm_mean(both, frame, x, {out: alpha}).filter(~F.col("_seed")).drop("_seed")


def slice_edges(df: DataFrame, ts: str, days: int) -> list[str]:
    """First instants of slices of ``days`` days over a table's time range (the first slice is open to the left)."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    edges, at = [], low
    while at is not None and (at := at + timedelta(days=days)) <= high:
        edges.append(str(at))
    return edges


def in_slices(df: DataFrame, frame: Frame, edges: Sequence[str], step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], folder: str) -> DataFrame:
    """Run any recursion over bounded time slices with a state table between them.

    ``step(slice, state)`` returns (output, new state). Output and state of a slice are written to the
    shared folder, so a lost executor re-reads them instead of recomputing earlier slices, and a key of
    any size is only ever in a task one slice at a time. The loop runs over slice edges (a calendar).
    """
    spark, ts = df.sparkSession, frame.order[0]
    state: DataFrame | None = None
    lows = [None, *edges]
    for i, lo in enumerate(lows):
        hi = lows[i + 1] if i + 1 < len(lows) else None
        part = df
        if lo is not None:
            part = part.filter(F.col(ts) >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            part = part.filter(F.col(ts) < F.lit(hi).cast("timestamp_ntz"))
        out, new_state = step(part, state)
        out.persist()  # the new state comes from the output: it is computed once
        out.write.mode("overwrite").parquet(f"{folder}/out/slice={i}")
        new_state.write.mode("overwrite").parquet(f"{folder}/state/slice={i}")
        out.unpersist()
        state = spark.read.parquet(f"{folder}/state/slice={i}")
    return spark.read.parquet(f"{folder}/out").drop("slice")
