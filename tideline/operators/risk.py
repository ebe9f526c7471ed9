"""Order checks, circuit breakers, position folds and triggers over tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions.frames import Col, Frame, bool0, col, div

MONEY = T.DecimalType(38, 18)
ZERO = Decimal(0)


def apply_fill(qty: Decimal, cost: Decimal, pnl: Decimal, fill: Decimal, price: Decimal) -> tuple[Decimal, Decimal, Decimal]:
    """(quantity, average cost, realised pnl) after one fill: open, add, reduce, close or flip."""
    left = qty + fill
    if qty == 0:
        return left, price, pnl
    if (qty > 0) == (fill > 0):
        return left, (qty * cost + fill * price) / left, pnl
    closed = min(abs(fill), abs(qty))
    pnl += (price - cost) * closed if qty > 0 else (cost - price) * closed
    if left == 0:
        return ZERO, ZERO, pnl
    return left, (price if (left > 0) != (qty > 0) else cost), pnl


def fold_fills(fills: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running quantity, average cost and realised pnl per key in exact decimals."""
    d = fills.select(*keys, *order, F.col("qty").cast(MONEY).alias("qty"), F.col("price").cast(MONEY).alias("price"))
    schema = T.StructType([*d.schema.fields, *[T.StructField(n, MONEY) for n in ("position", "avg_cost", "realized_pnl")]])
    tick = Decimal(1).scaleb(-18)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import decimal

        pdf = pdf.sort_values(list(order), kind="stable")
        with decimal.localcontext() as ctx:
            ctx.prec = 60
            state = (ZERO, ZERO, ZERO)
            rows = []
            for q, p in zip(pdf["qty"], pdf["price"]):
                state = tuple(v.quantize(tick) for v in apply_fill(*state, q, p))
                rows.append(state)
        return pdf.assign(position=[r[0] for r in rows], avg_cost=[r[1] for r in rows], realized_pnl=[r[2] for r in rows])

    return d.groupBy(*keys).applyInPandas(run, schema)


def fold_fills_in_slices(fills: DataFrame, keys: Sequence[str], order: Sequence[str], edges: Sequence[str], folder: str) -> DataFrame:
    """``fold_fills`` for keys with any number of fills: time slices one after the other, with a state row for each key.

    A task streams the fills of one slice in order of key and time and holds one state. ``edges`` are the slices' first instants (``slice_edges``); output and state of every
    slice are tables in ``folder``.
    """
    from tideline.plans.incremental import in_slices

    d = fills.select(*keys, *order, F.col("qty").cast(MONEY).alias("qty"), F.col("price").cast(MONEY).alias("price"))
    names = ["position", "avg_cost", "realized_pnl"]
    schema = T.StructType([*d.schema.fields, *[T.StructField(n, MONEY) for n in names]])
    arrow = to_arrow_schema(schema)
    tick = Decimal(1).scaleb(-18)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fills in order of (key, time); a key's row without ``_fill`` comes first and holds its state."""
        import decimal

        now, state = None, (ZERO, ZERO, ZERO)
        with decimal.localcontext() as ctx:
            ctx.prec = 60
            for batch in batches:
                ids = zip(*[batch.column(k).to_pylist() for k in keys])
                rows = []
                for key, fill, q, p, old in zip(ids, *[batch.column(c).to_pylist() for c in ("_fill", "qty", "price")], zip(*[batch.column(n).to_pylist() for n in names])):
                    if key != now:
                        now, state = key, (ZERO, ZERO, ZERO)
                    state = tuple(v.quantize(tick) for v in apply_fill(*state, q, p)) if fill else old
                    rows.append(state)
                if rows:
                    some = batch.select([*keys, *order, "qty", "price"]).columns + [pa.array(v, pa.decimal128(38, 18)) for v in zip(*rows)]
                    kept = batch.column("_fill")
                    yield pa.RecordBatch.from_arrays([c.cast(f.type).filter(kept) for c, f in zip(some, arrow)], schema=arrow)

    def step(part: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        both = part.withColumns({"_fill": F.lit(True)} | {n: F.lit(None).cast(MONEY) for n in names})
        if state is not None:
            both = both.unionByName(state.withColumn("_fill", F.lit(False)), allowMissingColumns=True)
        out = both.repartition(*keys).sortWithinPartitions(*keys, "_fill", *order).mapInArrow(run, schema)
        last = out.groupBy(*keys).agg(*[F.max_by(n, F.struct(*order)).alias(n) for n in names])
        idle = last if state is None else last.unionByName(state.join(part.select(*keys).distinct(), list(keys), "left_anti"))
        return out, idle

    return in_slices(d, Frame(tuple(keys), tuple(order)), edges, step, folder)


def breaker_state(trades: DataFrame, f: Frame, pnl: str = "pnl", limit: int = 3) -> DataFrame:
    """Consecutive losses so far (a profit restarts the count) and whether the breaker trips."""
    df = trades.withColumn("_run", F.sum((F.col(pnl) > 0).cast("int")).over(f.cum))
    inside = Frame((*f.keys, "_run"), f.order)
    df = df.withColumn("loss_streak", F.sum((F.col(pnl) < 0).cast("int")).over(inside.cum))
    return df.withColumn("tripped", F.col("loss_streak") >= limit).drop("_run")


def daily_loss(values: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", cap: float = 0.03) -> DataFrame:
    """Drawdown of each row from the first value of its day against the cap."""
    day = F.col(ts).cast("date")
    g = values.groupBy(*keys, day.alias("_day")).agg(F.min_by(value, ts).alias("_open"))
    out = values.withColumn("_day", day).join(g, [*keys, "_day"])
    dd = div(F.col(value) - F.col("_open"), "_open")
    return out.withColumn("intraday_dd", dd).withColumn("breach", bool0(F.col("intraday_dd") < -cap)).drop("_day", "_open")


def check_orders(orders: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Approve or reject each order with the reasons; limits is a small table of caps per ``by``."""
    j = orders.join(limits, list(by), "left")
    notional = F.abs(F.col("qty")) * F.col("price")
    after = F.col("position_value") + F.when(F.col("side") == "buy", notional).otherwise(-notional)
    rules = [
        ("halted", bool0(F.col("halted"))),
        ("position_cap", bool0(F.abs(after) > F.col("max_position_pct") * F.col("portfolio_value"))),
        ("portfolio_cap", bool0((F.col("gross_value") + notional) > F.col("max_portfolio_pct") * F.col("portfolio_value")) & (F.col("side") == "buy")),
        ("daily_loss", bool0(F.col("day_pnl_pct") < -F.col("daily_loss_cap"))),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return j.withColumn("reasons", F.array_join(reasons, ",")).withColumn("approved", F.col("reasons") == "")


def flatten_trigger(vol: Col, ret: Col, healthy: Col, corr: Col, reduce_vol: float = 0.0923, flatten_vol: float = 0.1194, big_move: float = 0.15, low_corr: float = -0.20) -> Column:
    """struct(state, trigger) of the first rule that fires, most severe first."""
    s = lambda a, b: F.struct(F.lit(a).alias("state"), F.lit(b).cast("string").alias("trigger"))
    return (F.when(~F.coalesce(col(healthy), F.lit(True)), s("flatten", "exchange_halt"))
            .when(bool0(F.abs(col(ret)) > big_move), s("flatten", "abs_return"))
            .when(bool0(col(vol) > flatten_vol), s("flatten", "vol_spike"))
            .when(bool0(col(corr) < low_corr), s("flatten", "correlation_breakdown"))
            .when(bool0(col(vol) > reduce_vol), s("reduce", "vol_spike"))
            .otherwise(s("normal", None)))


def escalations(events: DataFrame, keys: Sequence[str], as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Keys whose newest event is a pause older than ``days`` days."""
    last = events.groupBy(*keys).agg(F.max_by("event", ts).alias("event"), F.max(ts).alias("since"))
    return last.withColumn("paused_days", F.datediff(as_of, "since")).withColumn("escalate", (F.col("event") == "pause") & (F.col("paused_days") > days))


def target_positions(signals: DataFrame, config: DataFrame, by: Sequence[str]) -> DataFrame:
    """Target quantity by sizing mode, regime cap and confidence."""
    j = signals.join(config, list(by))
    base = F.when(F.col("mode") == "fixed_fraction", F.col("fraction")).when(
        F.col("mode") == "confidence", F.col("fraction") * F.coalesce("confidence", F.lit(0.0))).otherwise(
        F.least(F.try_divide(F.col("fraction"), F.col("vol")), F.lit(1.0)))
    share = F.least(base * F.coalesce("regime_mult", F.lit(1.0)), F.col("max_fraction"))
    return j.withColumn("target_qty", F.col("direction") * share * F.col("portfolio_value") / F.col("price"))


def order_deltas(current: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    j = current.select(*keys, F.col("qty").alias("current_qty")).join(target.select(*keys, "target_qty"), list(keys), "full").na.fill(0.0, ["current_qty", "target_qty"])
    return j.withColumn("order_qty", F.col("target_qty") - F.col("current_qty"))


def recent_rows(df: DataFrame, by: Sequence[str], order: Column, n: int) -> DataFrame:
    """First n rows per group; the filter on row_number becomes a per-task group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def stop_hits(prices: DataFrame, positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Price rows at or through the stop or target of an open position (static or streaming prices)."""
    j = prices.join(positions, list(by))
    long = F.col("side") == "long"
    stop = F.when(long, F.col("price") <= F.col("stop_price")).otherwise(F.col("price") >= F.col("stop_price"))
    take = F.when(long, F.col("price") >= F.col("target_price")).otherwise(F.col("price") <= F.col("target_price"))
    return j.withColumn("hit", F.when(stop, "stop").when(take, "target")).filter("hit IS NOT NULL")
