"""Vendor files and pages: typed scans, parsing of names and numbers, unified histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.frames import Col, col

DAILY_CSV = "timeOpen string, timeClose string, timeHigh string, timeLow string, name string, open string, high string, low string, close string, volume string, marketCap string, timestamp string"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV of daily prices, all fields as text, with the file they came from."""
    return read_csv(spark, path, DAILY_CSV, ";").withColumn("source_file", F.input_file_name())


def typed_daily(df: DataFrame) -> DataFrame:
    """Cast text columns; an unreadable number or time becomes NULL."""
    num = ["open", "high", "low", "close", "volume", "marketCap"]
    times = ["timeOpen", "timeClose", "timeHigh", "timeLow", "timestamp"]
    return df.withColumns({c: F.col(c).try_cast("double") for c in num} | {c: F.col(c).try_cast("timestamp") for c in times})


def rows_after_watermark(rows: DataFrame, table: DataFrame, keys: Sequence[str], ts: str, full: bool = False) -> DataFrame:
    """New rows only: later than the key's newest stored row (all rows on a full load)."""
    if full:
        return rows
    m = table.groupBy(*keys).agg(F.max(ts).alias("_m"))
    return rows.join(m, list(keys), "left").filter(F.col("_m").isNull() | (F.col(ts) > F.col("_m"))).drop("_m")


def epoch_rows(df: DataFrame, listings: DataFrame) -> DataFrame:
    """Second vendor: epoch seconds to UTC; asset and venue from the listing of its file name."""
    return df.withColumn("ts", F.timestamp_seconds(F.col("time").try_cast("bigint"))).join(listings, "source_name").withColumns(
        {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")})


def keep_lowest_rank(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    payload = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.min_by(payload, F.col(rank)).alias("_r")).select(*keys, "_r.*")


# Magnitude suffixes of printed numbers.
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def parse_number(text: Col) -> Column:
    """'$35.9 T' -> 3.59e13; NULL when there is no number."""
    t = col(text)
    number = F.regexp_replace(F.regexp_extract(t, r"(-?[\d,]*\.?\d+)", 1), ",", "").try_cast("double")
    suffix = F.upper(F.regexp_extract(t, r"\d\s*([KMBTkmbt])\b", 1))
    factor = F.lit(1.0)
    for s, m in SUFFIXES.items():
        factor = F.when(suffix == s, m).otherwise(factor)
    return number * factor


def parse_percent(text: Col) -> Column:
    return F.regexp_replace(F.regexp_extract(col(text), r"(-?[\d,]*\.?\d+)\s*%", 1), ",", "").try_cast("double")


def page_items(pages: DataFrame, item: str = r"(?s)<li>(.*?)</li>", html: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per repeated HTML item of a page: position, link and text."""
    d = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(item), F.lit(1))).alias("position", "item"))
    return d.select(
        id_col, "position", F.regexp_extract("item", r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("item", r"(?s)<[^>]*>", "")).alias("label"))


def parse_file_name(name: Col) -> dict[str, Column]:
    """'VENUE_TICKER, 1D_x.csv' -> venue, ticker, tf."""
    pattern = r"^([A-Za-z]+)_([A-Za-z0-9.]+)[,_ ]+(\d+[A-Za-z]*)"
    base = F.regexp_extract(col(name), r"([^/]+)$", 1)
    return {k: F.regexp_extract(base, pattern, i) for k, i in (("venue", 1), ("ticker", 2), ("tf", 3))}


# Quote suffixes cut from venue tickers, longest first, and venues by asset class.
QUOTES = ("USDT", "USDC", "USD", "PERP")
CLASS_OF_VENUE = {"NASDAQ": "equity", "NYSE": "equity", "BINANCE": "crypto", "KRAKEN": "crypto", "COINBASE": "crypto"}


def canonical_symbol(ticker: Col, venue: Col) -> Column:
    t = F.upper(col(ticker))
    cut = F.regexp_replace(t, f"({'|'.join(QUOTES)})$", "")
    return F.when(asset_class(ticker, venue) == "crypto", F.when(cut == "", t).otherwise(cut)).otherwise(t)


def asset_class(symbol: Col, venue: Col) -> Column:
    v = F.upper(col(venue))
    out = F.lit("unknown")
    for name, cls in CLASS_OF_VENUE.items():
        out = F.when(v == name, cls).otherwise(out)
    return F.when(out != "unknown", out).when(F.upper(col(symbol)).rlike(f"({'|'.join(QUOTES)})$"), "crypto").otherwise(out)


def json_entries(df: DataFrame, payload: str, schema: str = "array<struct<value: string, timestamp: string, label: string>>") -> DataFrame:
    """API entries stored as JSON text -> typed rows."""
    d = df.withColumn("_e", F.explode(F.from_json(payload, schema)))
    return d.select(*[c for c in df.columns if c != payload], F.col("_e.value").try_cast("int").alias("value"), F.timestamp_seconds(F.col("_e.timestamp").try_cast("bigint")).alias("ts"), F.col("_e.label").alias("label"))


def filtered_bars(df: DataFrame, ids: Sequence[int] | None, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Daily scan by id list and inclusive time range (both reach the Parquet scan)."""
    if ids is not None:
        df = df.filter(F.col("id").isin(list(ids)))
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))


def close_panel(df: DataFrame, ids: Sequence[int], ts: str = "ts") -> DataFrame:
    """Long to wide closes; the id list is explicit, so no pass finds the columns."""
    return df.groupBy(ts).pivot("id", list(ids)).agg(F.first("close"))


def daily_grid(long: DataFrame, series: Sequence[str], date: str = "date") -> DataFrame:
    """(series, date, value) -> one row per calendar day with a column per series."""
    wide = long.groupBy(date).pivot("series", list(series)).agg(F.first("value"))
    grid = long.agg(F.min(date).alias("a"), F.max(date).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(date))
    return grid.join(wide, date, "left")


def unified_history(tables: Mapping[str, DataFrame], listings: DataFrame | None = None, on: Sequence[str] = ("id",)) -> DataFrame:
    """Union of vendor histories with aligned columns, a source tag and the listing names."""
    out: DataFrame | None = None
    for name, df in tables.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out if listings is None else out.join(listings, list(on), "left")


def perp_frame(funding: DataFrame, oi: DataFrame, marks: DataFrame, candles: DataFrame, on: Sequence[str] = ("id", "day")) -> DataFrame:
    """Daily funding sum, last open interest, last mark and candles of a perpetual on one row."""
    f = funding.groupBy(*on).agg(F.sum("rate").alias("funding"))
    o = oi.groupBy(*on).agg(F.max_by("oi", "ts").alias("oi"))
    m = marks.groupBy(*on).agg(F.max_by("mark", "ts").alias("mark"))
    return candles.join(f, list(on), "left").join(o, list(on), "left").join(m, list(on), "left")
