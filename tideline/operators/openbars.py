"""Bars grown by increments: the open bar of every (key, timeframe) is a row of state, and new days are folded into it.

The state holds what a bar needs to go on: first price and time, extremes with their times, volume, days, gaps and its place. It enters the
windows of a batch as one row in front of the new days, so a batch gives the rows that a full build gives, while days that
were folded before are never read again. Days that are not newer than the state are left out: a batch that is repeated adds nothing.

Whether an anchored bar was cut short is known only when its period has passed. Rows are therefore never rewritten: a batch also lists
the bars that ended with it (``closings``, one row a bar, taken from the batch's written rows like the next state), and ``finished`` joins both to the columns of the full build.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.frames import Frame
from tideline.operators.bars import aligned_period, anchored_period, first_full_period, one_ms

COUNT, CALENDAR, ANCHORED = "count", "calendar", "anchored"
CARRIED = ("bar_seq", "tf_days", "period_start", "period_end", "open", "high", "low", "volume", "time_high", "time_low", "time_open_bar", "count_days", "count_missing_days")


class Bars:
    """What kind of bars is grown. ``specs``: day counts, or (n, unit) of calendar periods; ``scheme``: iso or us weeks."""

    def __init__(self, kind: str, specs: Sequence, scheme: str = "iso", keys: Sequence[str] = ("id",), ts: str = "ts"):
        self.kind, self.specs, self.scheme, self.keys, self.ts = kind, tuple(specs), scheme, tuple(keys), ts
        self.by = (*self.keys, "tf")

    def spread(self, days: DataFrame) -> DataFrame:
        """Each day once for each timeframe: tf, tf_days, period_start, period_end. Calendar bars need ``first_day`` of the key."""
        day, none = F.col(self.ts).cast("date"), F.lit(None).cast("date")
        items = []
        for spec in self.specs:
            if self.kind == COUNT:
                items.append(F.struct(F.lit(f"{spec}D").alias("tf"), F.lit(int(spec)).alias("tf_days"), none.alias("period_start"), none.alias("period_end")))
                continue
            n, unit = spec
            if self.kind == ANCHORED:
                start, end = anchored_period(day, n, unit, self.scheme)
            else:
                anchor = first_full_period("first_day", unit, self.scheme)
                _, start, end = aligned_period(day, anchor, n, unit)
                start = F.when(day >= anchor, start)
            items.append(F.struct(F.lit(f"{n}{unit}").alias("tf"), (F.datediff(end, start) + 1).alias("tf_days"), start.alias("period_start"), end.alias("period_end")))
        d = days.withColumn("_p", F.explode(F.array(*items)))
        return d.select(*days.columns, "_p.*")


def fold_days(days: DataFrame, state: DataFrame | None, bars: Bars) -> DataFrame:
    """Rows of ``days`` (keys, ts, open, high, low, close, volume) after ``state`` (see ``next_state``; None at the start).

    Rows with ``is_state`` are no output: the state rows that bars went on from, and timeframes whose first whole period is still to come.
    """
    ts, by, keys = bars.ts, list(bars.by), list(bars.keys)
    days = days.select(*keys, ts, "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    firsts = days.groupBy(*keys).agg(F.min(F.col(ts).cast("date")).alias("first_day"))
    if state is not None:
        old = state.groupBy(*keys).agg(F.first("first_day").alias("_f"))
        firsts = firsts.join(old, keys, "full").withColumn("first_day", F.coalesce("_f", "first_day")).drop("_f")
    new = bars.spread(days.join(firsts, keys))
    if state is not None:
        new = new.join(state.select(*by, F.col(ts).alias("_last")), by, "left").filter(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
    # a day before the first whole period has no bar, but its key and timeframe have a state row
    waiting = new.groupBy(*by).agg(F.first("first_day").alias("first_day"))
    new = new.filter("period_start IS NOT NULL OR period_end IS NULL" if bars.kind == COUNT else "period_start IS NOT NULL")
    rows = new.select(
        *by, ts, "first_day", "tf_days", "period_start", "period_end", "open", "high", "low", "close", "volume", F.col(ts).alias("_high_at"), F.col(ts).alias("_low_at"),
        F.lit(1).cast("long").alias("_days"), F.lit(None).cast("long").alias("_gaps"), F.lit(None).cast(days.schema[ts].dataType).alias("_opened"), F.lit(None).cast("int").alias("_seq"),
    )
    if state is not None:
        seed = state.filter("bar_seq IS NOT NULL").select(
            *by, ts, "first_day", "tf_days", "period_start", "period_end", "open", "high", "low", F.lit(None).cast("double").alias("close"), "volume", F.col("time_high").alias("_high_at"),
            F.col("time_low").alias("_low_at"), F.col("count_days").cast("long").alias("_days"), F.col("count_missing_days").cast("long").alias("_gaps"), F.col("time_open_bar").alias("_opened"), F.col("bar_seq").cast("int").alias("_seq"),
        )
        rows = seed.join(rows.select(*by).distinct(), by, "left_semi").unionByName(rows)
    run = Frame(by, (ts,))
    old_seq = F.coalesce(F.first("_seq").over(run.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(1))
    if bars.kind == COUNT:
        index = (old_seq - 1) * F.col("tf_days") + F.sum("_days").over(run.cum)
        rows = rows.withColumn("bar_seq", F.floor((index - 1) / F.col("tf_days")).cast("int") + 1)
    else:
        rows = rows.withColumn("bar_seq", (old_seq - 1 + F.dense_rank().over(Window.partitionBy(*by).orderBy("period_start"))).cast("int"))
    bar = Frame((*by, "bar_seq"), (ts,))
    before = run.lag(ts)
    opened = F.coalesce("_opened", F.coalesce(before, F.col(ts) - F.expr("INTERVAL 1 DAY")) + one_ms())
    gap = F.coalesce("_gaps", F.when(bar.rn() == 1, F.lit(0)).otherwise(F.greatest(F.datediff(ts, before) - 1, F.lit(0))).cast("long"))
    rows = rows.withColumns({"time_open": opened, "_gap": gap})
    running = {
        "_open": F.first("open").over(bar.cum), "_high": F.max("high").over(bar.cum), "_low": F.min("low").over(bar.cum), "_volume": F.sum("volume").over(bar.cum),
        "time_high": F.min_by("_high_at", F.struct(-F.col("high"), F.col("_high_at"))).over(bar.cum), "time_low": F.min_by("_low_at", F.struct(F.col("low"), F.col("_low_at"))).over(bar.cum),
        "time_open_bar": F.first("time_open").over(bar.cum), "count_days": F.sum("_days").over(bar.cum), "count_missing_days": F.sum("_gap").over(bar.cum),
    }
    rows = rows.withColumns(running)
    rows = rows.select(*by, ts, "first_day", "_seq", "tf_days", "bar_seq", "period_start", "period_end", F.col("_open").alias("open"), F.col("_high").alias("high"), F.col("_low").alias("low"), "close",
                       F.col("_volume").alias("volume"), "time_open", "time_high", "time_low", "time_open_bar", "count_days", "count_missing_days")
    rows = rows.withColumn("is_state", F.col("_seq").isNotNull()).drop("_seq")
    return rows.unionByName(waiting.withColumn("is_state", F.lit(True)), allowMissingColumns=True)


def closings(folded: DataFrame, bars: Bars) -> DataFrame:
    """keys, tf, bar_seq, bar_days of the bars that another bar follows."""
    by = list(bars.by)
    ends = folded.filter("bar_seq IS NOT NULL").groupBy(*by, "bar_seq").agg(F.max("count_days").alias("bar_days"))
    newest = F.max("bar_seq").over(Window.partitionBy(*by))
    return ends.withColumn("_now", newest).filter(F.col("bar_seq") < F.col("_now")).drop("_now")


def next_state(folded: DataFrame, state: DataFrame | None, bars: Bars) -> DataFrame:
    """The open bar of each key and timeframe; one without a bar yet keeps the key's first day."""
    by = list(bars.by)
    last = folded.groupBy(*by).agg(F.min("first_day").alias("first_day"), F.max_by(F.struct(bars.ts, *CARRIED), bars.ts).alias("s")).select(*by, "first_day", "s.*")
    return last if state is None else state.join(last.select(*by), by, "left_anti").unionByName(last)


def append_days(days: DataFrame, bars: Bars, folder: str, batch: int) -> None:
    """Fold one batch: reads the state table of batch - 1 in the shared folder, writes rows, closings and state of this one."""
    spark = days.sparkSession
    state = spark.read.parquet(f"{folder}/state/batch={batch - 1}") if batch else None
    fold_days(days, state, bars).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
    folded = spark.read.parquet(f"{folder}/rows/batch={batch}")
    closings(folded, bars).write.mode("overwrite").parquet(f"{folder}/closings/batch={batch}")
    next_state(folded, state, bars).write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")


def finished(spark: SparkSession, bars: Bars, folder: str) -> DataFrame:
    """All rows of the batches so far, with the columns of the full build."""
    rows = spark.read.parquet(f"{folder}/rows").filter("NOT is_state").drop("batch", "is_state", "first_day")
    left = F.col("tf_days") - F.col("count_days")
    if bars.kind == COUNT:
        return rows.drop("period_start", "period_end").withColumns({"pos_in_bar": F.col("count_days"), "is_partial_end": left > 0, "count_days_remaining": left})
    if bars.kind == CALENDAR:
        return rows.withColumns({"is_partial_start": F.lit(False), "is_partial_end": left > 0, "count_days_remaining": left})
    ended = spark.read.parquet(f"{folder}/closings").drop("batch")
    rows = rows.join(ended, [*bars.by, "bar_seq"], "left")
    expected = F.coalesce("bar_days", "tf_days")
    flags = {"is_partial_start": F.coalesce(F.col("bar_days") < F.col("tf_days"), F.lit(False)), "is_partial_end": F.col("count_days") < expected, "count_days_remaining": expected - F.col("count_days")}
    return rows.withColumns(flags).drop("bar_days")
