"""Live variants: windows with watermarks, keyed state, exactly-once merges.

State is per key and small (a last value, an open bar, a running EMA); event time drives expiry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """File stream with an explicit schema; zone-less timestamps become instants for watermarks."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    fixes = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(fixes) if fixes else df


def ohlcv(ticks: DataFrame, key: str, every: str, late: str, ts: str = "ts", price: str = "price", size: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars; a window closes when the watermark passes its end."""
    qty = F.lit(1.0) if size is None else F.col(size)
    w = ticks.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, every))
    return w.agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(qty).alias("volume"),
    ).select(key, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def last_prices(ticks: DataFrame, key: str, ts: str = "ts", price: str = "price") -> DataFrame:
    """Latest price per key (update mode)."""
    return ticks.groupBy(key).agg(F.max_by(price, ts).alias("price"), F.max(ts).alias("as_of"))


def _field(name: str, t: T.DataType) -> T.StructField:
    return T.StructField(name, t)


class EmaProcessor(StatefulProcessor):
    """Running EMA per key; rows of a batch are applied in event order."""

    def __init__(self, alpha: float, ts: str, x: str):
        self.alpha, self.ts, self.x = alpha, ts, x

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("ema", T.StructType([_field("v", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        cur = self.value.get()[0] if self.value.exists() else None
        out = []
        for v in pdf[self.x].tolist():
            if v == v:
                cur = v if cur is None else self.alpha * v + (1 - self.alpha) * cur
            out.append(cur)
        if cur is not None:
            self.value.update((float(cur),))
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "ts": pdf[self.ts].to_numpy(), "ema": out})

    def close(self) -> None:
        pass


class CusumProcessor(StatefulProcessor):
    """CUSUM events on log steps; state is the last price and both sums."""

    def __init__(self, threshold: float, ts: str, x: str):
        self.threshold, self.ts, self.x = threshold, ts, x

    def init(self, handle: StatefulProcessorHandle) -> None:
        d = T.DoubleType()
        self.value = handle.getValueState("cusum", T.StructType([_field("last", d), _field("up", d), _field("dn", d)]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        last, up, dn = tuple(self.value.get()) if self.value.exists() else (None, 0.0, 0.0)
        hits = []
        for t, v in zip(pdf[self.ts], pdf[self.x].tolist()):
            if not v > 0:
                continue
            if last is not None:
                step = math.log(v / last)
                up, dn = max(0.0, up + step), min(0.0, dn + step)
                if up >= self.threshold:
                    up = 0.0
                    hits.append((t, 1))
                elif dn <= -self.threshold:
                    dn = 0.0
                    hits.append((t, -1))
            last = v
        if last is not None:
            self.value.update((float(last), float(up), float(dn)))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(hits), dtype="int64"), "ts": pd.Series([h[0] for h in hits], dtype="datetime64[us]"), "direction": pd.Series([h[1] for h in hits], dtype="int32")})

    def close(self) -> None:
        pass


class PositionProcessor(StatefulProcessor):
    """Net position, average cost and realised pnl per key in exact decimals."""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        s = T.StringType()
        self.value = handle.getValueState("position", T.StructType([_field("q", s), _field("c", s), _field("p", s)]))

    def handleInputRows(self, key, rows, timerValues):
        from decimal import Decimal, localcontext

        from tideline.operators.risk import apply_fill

        pdf = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        state = tuple(Decimal(v) for v in self.value.get()) if self.value.exists() else (Decimal(0),) * 3
        tick = Decimal(1).scaleb(-18)
        out = []
        with localcontext() as ctx:
            ctx.prec = 60
            for q, p in zip(pdf["qty"], pdf["price"]):
                state = tuple(v.quantize(tick) for v in apply_fill(*state, Decimal(str(q)), Decimal(str(p))))
                out.append(tuple(float(v) for v in state))
        self.value.update(tuple(str(v) for v in state))
        yield pd.DataFrame({"key": [key[0]] * len(out), "ts": pdf[self.ts].to_numpy(), "position": [o[0] for o in out], "avg_cost": [o[1] for o in out], "realized_pnl": [o[2] for o in out]})

    def close(self) -> None:
        pass


class StaleProcessor(StatefulProcessor):
    """Emits a key when no row came for ``max_age_ms`` of event time (a timer per key)."""

    def __init__(self, ts: str, max_age_ms: int):
        self.ts, self.max_age_ms = ts, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("seen", T.StructType([_field("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(pdf[self.ts].max().timestamp() * 1000) for pdf in rows)
        old = self.value.get()[0] if self.value.exists() else None
        if old is None or newest > old:
            if old is not None:
                self.handle.deleteTimer(old + self.max_age_ms)
            self.value.update((newest,))
            self.handle.registerTimer(newest + self.max_age_ms)
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.value.exists():
            yield pd.DataFrame({"key": [key[0]], "last_ms": [self.value.get()[0]]})

    def close(self) -> None:
        pass


EMA_OUT = "key long, ts timestamp, ema double"
CUSUM_OUT = "key long, ts timestamp, direction int"
POSITION_OUT = "key long, ts timestamp, position double, avg_cost double, realized_pnl double"
STALE_OUT = "key long, last_ms long"


def running_ema(ticks: DataFrame, key: str, alpha: float, ts: str = "ts", x: str = "price") -> DataFrame:
    return ticks.select(key, ts, x).groupBy(key).transformWithStateInPandas(EmaProcessor(alpha, ts, x), T._parse_datatype_string(EMA_OUT), "append", "none")


def running_cusum(ticks: DataFrame, key: str, threshold: float, ts: str = "ts", x: str = "price") -> DataFrame:
    return ticks.select(key, ts, x).groupBy(key).transformWithStateInPandas(CusumProcessor(threshold, ts, x), T._parse_datatype_string(CUSUM_OUT), "append", "none")


def running_positions(fills: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return fills.select(key, ts, "qty", "price").groupBy(key).transformWithStateInPandas(PositionProcessor(ts), T._parse_datatype_string(POSITION_OUT), "append", "none")


def stale_keys(ticks: DataFrame, key: str, max_age_ms: int, late: str, ts: str = "ts") -> DataFrame:
    return ticks.select(key, ts).withWatermark(ts, late).groupBy(key).transformWithStateInPandas(StaleProcessor(ts, max_age_ms), T._parse_datatype_string(STALE_OUT), "append", "eventTime")


def stop_hits(prices: DataFrame, positions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stream-static join of live prices with open positions, filtered on their levels."""
    from tideline.operators.risk import stop_hits as hits

    return hits(prices, positions, by)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drive a bounded stream to completion into a memory table (tests, small backfills)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch exactly once to Parquet files."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
