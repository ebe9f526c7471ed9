"""Statistics of all pairs of series by blocked matrix products: no row meets the rows of all other keys.

Series are dealt to blocks by a hash of their id. A block is one binary cell, written once to the checkpoint folder; a pair of
blocks is the unit of work, and its task reads the two cells from there. So nothing is copied for each pair: shuffle and disk
grow with the rows, while the work (and the files read) grows with the pairs, as all pairs must. A task walks over the two
blocks' days in chunks and adds matrix products to one number per pair of ids. Blocks number at least ``LEAST`` so that a small
universe still makes many tasks; they get smaller where histories are long (``CELL`` bytes when every day is filled).

Panels have at most one row per (id, day); rows without id or day take no part, and null, NaN or infinite values count as
missing. Days are numbered by the days that occur (their list, bounded by the calendar, goes through the driver), so a monthly
panel costs no more than its months. All functions run jobs while called: the packed series, their count and the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions.frames import Frame, div
from tideline.session import checkpoint_dir

CHUNK = 512
LEAST = 8
CELL = 128 << 20
ROWS = 65536


class Block:
    """Series of a block: ids, and (series, day, values) of every row."""

    def __init__(self, cell: bytes):
        t = pa.ipc.open_stream(cell).read_all().combine_chunks()
        self.ids = t.column("_id").to_pylist()
        days = t.column("_d").chunk(0)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(days.offsets.to_numpy()))
        self.day = days.flatten().to_numpy()
        v = t.column("_v").chunk(0).flatten().to_numpy(zero_copy_only=False)
        self.v = v.reshape(len(self.day), -1)

    def dense(self, lo: int, hi: int, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Values (id, day, column; NaN where missing) and whether there is a row, on days lo to hi."""
        at = np.flatnonzero((self.day >= lo) & (self.day < hi))
        v = self.v[at, columns]
        cube = np.full((len(self.ids), hi - lo, v.shape[1]), np.nan)
        cube[self.row[at], self.day[at] - lo] = np.where(np.isfinite(v), v, np.nan)
        seen = np.zeros((len(self.ids), hi - lo), bool)
        seen[self.row[at], self.day[at] - lo] = True
        return cube, seen


def packed(df: DataFrame, values: Sequence[str], key: str, ts: str) -> DataFrame:
    """(_id, _d, _v): one row per id with its days and their values one after the other; checkpointed."""
    day = F.datediff(ts, F.lit("1970-01-01").cast("date"))
    rows = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    point = F.struct(day.alias("d"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in values]).alias("v"))
    rows = rows.groupBy(F.col(key).alias("_id")).agg(F.collect_list(point).alias("_p"))
    return rows.select("_id", F.col("_p.d").alias("_d"), F.flatten("_p.v").alias("_v")).checkpoint()


def cells(rows: DataFrame, blocks: int, days: np.ndarray) -> DataFrame:
    """(_block, _cell): one row per block, checkpointed one block to a partition."""
    ids = to_arrow_schema(rows.select("_id").schema).field(0)
    form = pa.schema([pa.field("_id", ids.type), pa.field("_d", pa.list_(pa.int32())), pa.field("_v", pa.list_(pa.float64()))])
    out = pa.schema([("_block", pa.int32()), ("_cell", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("_block")[0].as_py()
            d = b.column("_d")
            at = np.searchsorted(days, d.flatten().to_numpy()).astype(np.int32)
            off = d.offsets.to_numpy()
            at = pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(at))
            parts.append(pa.RecordBatch.from_arrays([b.column("_id").cast(ids.type), at, b.column("_v").cast(pa.list_(pa.float64()))], schema=form))
        if parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, form) as w:
                w.write_table(pa.Table.from_batches(parts).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=out)

    placed = rows.select(F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_block"), "_id", "_d", "_v")
    return placed.repartitionById(blocks, "_block").mapInArrow(run, "_block int, _cell binary").checkpoint()


def over_pairs(left: DataFrame, right: DataFrame, x: Sequence[str], y: Sequence[str], per_block: int, result: Callable, schema: str, key: str = "id", ts: str = "ts", once: bool = False) -> DataFrame:
    """``result(left block, its columns, right block, its columns, number of days)`` of every pair of blocks, as Arrow batches.

    ``once``: both sides are the same, and each pair of blocks is given in one order only.
    """
    checkpoint_dir(left.sparkSession)
    same = left is right
    a = packed(left, [*x, *y] if same else x, key, ts)
    b = a if same else packed(right, y, key, ts)
    cols = (slice(0, len(x)), slice(len(x), None) if same else slice(0, None))
    every = a.select(F.explode("_d").alias("d")) if same else a.select(F.explode("_d").alias("d")).unionByName(b.select(F.explode("_d").alias("d")))
    days = np.array(sorted(r.d for r in every.distinct().collect()), dtype=np.int64)
    n = a.count() if same else max(a.count(), b.count())
    fit = max(int(CELL // (8 * (len(x) + len(y)) * max(len(days), 1))), 1)
    blocks = max(math.ceil(n / min(per_block, fit)), min(LEAST, n), 1)
    ca = cells(a, blocks, days)
    cb = ca if same else cells(b, blocks, days)
    pairs = ca.select(F.col("_block").alias("_a"), F.col("_cell").alias("_x")).hint("shuffle_replicate_nl").crossJoin(cb.select(F.col("_block").alias("_b"), F.col("_cell").alias("_y")))
    if once:
        pairs = pairs.filter("_a <= _b")
    width = len(days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (Block(batch.column(c)[i].as_buffer()) for c in ("_x", "_y"))
                alike = once and batch.column("_a")[i].as_py() == batch.column("_b")[i].as_py()
                yield from result(one, cols[0], two, cols[1], width, alike)

    return pairs.mapInArrow(run, schema)


class Sums:
    """n, sums, squares and products of every pair (left id, right id) of two value columns, and days on which both have a row."""

    def __init__(self, nx: int, ny: int):
        self.s = np.zeros((6, nx, ny))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        here, there = ~np.isnan(x), ~np.isnan(y)
        mx, my, vx, vy = here.astype(float), there.astype(float), np.where(here, x, 0.0), np.where(there, y, 0.0)
        self.s[0] += met(here, there)
        for k, (a, b) in enumerate(((vx, my), (mx, vy), (vx * vx, my), (mx, vy * vy), (vx, vy)), 1):
            self.s[k] += a @ b.T

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, sample covariance, correlation), NaN where fewer than two days or a constant side give none."""
        n, sx, sy, xx, yy, xy = self.s
        with np.errstate(invalid="ignore", divide="ignore"):
            cov = (xy - sx * sy / n) / (n - 1)
            vx, vy = xx - sx * sx / n, yy - sy * sy / n
            corr = cov * (n - 1) / np.sqrt(vx * vy)
            corr = np.where((n > 1) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy), corr, np.nan)
        return n, np.where(n > 1, cov, np.nan), corr


def met(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Days on which both are there, for every pair (single precision counts a chunk's days exactly)."""
    return here.astype(np.float32) @ there.astype(np.float32).T


def lagged(sums: list[Sums], xs: list[np.ndarray], px: np.ndarray, y: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Adds some days' products of each of ``xs`` (id, day) with ``y`` to its sums, and gives the days on which both have a row.

    A lag lacks its first rows only, so most days have a value in every column of every row. On those days the counts and the sums of the
    right side are the same for all columns and taken once; on the odd ones they are taken for each.
    """
    here, there = [~np.isnan(x) for x in xs], ~np.isnan(y)
    odd = (there != py).any(axis=0)
    for at in here:
        odd |= (at != px).any(axis=0)
    some = bool(odd.any())
    y, my = np.where(there, y, 0.0), there.astype(float)
    even = [a[:, ~odd] if some else a for a in (px, there, y)]
    n, mx = met(*even[:2]), even[0].astype(float)
    sy, yy = mx @ even[2].T, mx @ (even[2] * even[2]).T
    for x, at, own in zip(xs, here, sums):
        x = np.where(at, x, 0.0)
        own.s[0] += n
        own.s[1] += x @ my.T
        own.s[2] += sy
        own.s[3] += (x * x) @ my.T
        own.s[4] += yy
        own.s[5] += x @ y.T
        if some:
            rest, left = at[:, odd].astype(float), y[:, odd]
            for k, v in ((0, my[:, odd]), (2, left), (4, left * left)):
                own.s[k] += rest @ v.T
    return n + met(px[:, odd], py[:, odd]) if some else n


def plain(ids: list) -> np.ndarray:
    a = np.array(ids)
    return a if a.dtype.kind in "iu" else np.array(ids, dtype=object)


def scaled(df: DataFrame, values: Sequence[str], key: str = "id") -> DataFrame:
    """Values less their id's mean, over its deviation: correlations stay the same, and sums keep their digits."""
    w = Window.partitionBy(key)
    good = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    return df.withColumns({c: F.coalesce(div(good(c) - F.avg(good(c)).over(w), F.stddev_pop(good(c)).over(w)), good(c) - F.avg(good(c)).over(w)) for c in values})


def id_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def leader_scores(long: DataFrame, x: str, lags: Sequence[int] = (1, 2, 3), by: str = "ts", min_obs: int = 30, per_block: int = 1024, key: str = "id") -> DataFrame:
    """Mean over followers of the best |corr(leader lagged k, follower)|, per leader.

    A follower is any other id with a row on a day of the leader; fewer than ``min_obs`` common values or a constant side
    count as 0. A block pair sends one row per leader, so no row per pair of ids is ever written.
    """
    f = Frame((key,), (by,))
    moved = [f"_l{k}" for k in lags]
    panel = long.filter(F.col(key).isNotNull() & F.col(by).isNotNull()).select(key, by, F.col(x).alias("_x"), *[f.lag(x, k).alias(c) for k, c in zip(lags, moved)])
    panel = scaled(panel, ["_x", *moved], key)
    schema = f"leader {id_type(long, key)}, s double, n long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def result(left: Block, cx: slice, right: Block, cy: slice, days: int, alike: bool) -> Iterator[pa.RecordBatch]:
        shape = (len(left.ids), len(right.ids))
        sums, both = [Sums(*shape) for _ in moved], np.zeros(shape)
        for lo in range(0, days, CHUNK):
            hi = min(lo + CHUNK, days)
            (vx, px), (vy, py) = left.dense(lo, hi, cx), right.dense(lo, hi, cy)
            both += lagged(sums, list(np.ascontiguousarray(np.moveaxis(vx, 2, 0))), px, vy[:, :, 0], py)
        best = np.zeros(shape)
        for one in sums:
            n, _, corr = one.moments()
            np.maximum(best, np.nan_to_num(np.abs(np.where(n >= min_obs, corr, 0.0))), out=best)
        pair = (both > 0) & np.not_equal.outer(plain(left.ids), plain(right.ids)).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(left.ids, arrow.field(0).type), pa.array((best * pair).sum(axis=1)), pa.array(pair.sum(axis=1).astype("int64"))], schema=arrow)

    parts = over_pairs(panel, panel, moved, ["_x"], per_block, result, schema, key, by)
    g = parts.groupBy("leader").agg(F.sum("s").alias("s"), F.sum("n").alias("n_followers")).filter("n_followers > 0")
    return g.select("leader", div("s", "n_followers").alias("leader_score"), "n_followers")


def pair_covariance(df: DataFrame, x: str, by: str = "ts", per_block: int = 1024, key: str = "id") -> DataFrame:
    """(id_a, id_b, n_obs, cov, corr) for all pairs id_a < id_b with a common value; the result has a row for each pair, no more."""
    centred = df.select(key, by, (F.col(x) - F.avg(x).over(Window.partitionBy(key))).alias("_x"))
    t = id_type(df, key)
    schema = f"id_a {t}, id_b {t}, n_obs long, cov double, corr double"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def result(left: Block, cx: slice, right: Block, cy: slice, days: int, alike: bool) -> Iterator[pa.RecordBatch]:
        sums = Sums(len(left.ids), len(right.ids))
        for lo in range(0, days, CHUNK):
            hi = min(lo + CHUNK, days)
            sums.add(left.dense(lo, hi, cx)[0][:, :, 0], right.dense(lo, hi, cy)[0][:, :, 0])
        a, b = plain(left.ids), plain(right.ids)
        step = max(ROWS // max(len(b), 1), 1)
        for lo in range(0, len(a), step):
            some = Sums(0, 0)
            some.s = sums.s[:, lo:lo + step]
            n, cov, corr = some.moments()
            keep = n > 0
            if alike:  # within one block both orders meet
                keep &= np.less.outer(a[lo:lo + step], b).astype(bool)
            i, j = np.nonzero(keep)
            p, q = a[lo + i], b[j]
            first = np.less(p, q).astype(bool)
            cols = [pa.array(np.where(first, p, q), arrow.field(0).type), pa.array(np.where(first, q, p), arrow.field(1).type), pa.array(n[i, j].astype("int64"))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v[i, j], pa.float64(), from_pandas=True) for v in (cov, corr)]], schema=arrow)

    return over_pairs(centred, centred, ["_x"], ["_x"], per_block, result, schema, key, by, once=True)


def rank_ic(left: DataFrame, right: DataFrame, x: str, y: Sequence[str], labels: Sequence[int], by: str = "ts", per_block: int = 32, key: str = "id") -> DataFrame:
    """Spearman of left ``x`` with each right ``y`` on common days: (leader, follower, horizon, ic, n_obs), no id with itself.

    Ranks depend on the days a pair shares, so a task holds the histories of two blocks (ids x calendar days) and ranks one
    leader against a whole block at a time.
    """

    schema = f"leader {id_type(left, key)}, follower {id_type(left, key)}, horizon int, ic double, n_obs long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def result(one: Block, cx: slice, two: Block, cy: slice, days: int, alike: bool) -> Iterator[pa.RecordBatch]:
        ids_x, ids_y = one.ids, two.ids
        xs, ys = one.dense(0, days, cx)[0], two.dense(0, days, cy)[0]
        out = []
        for i, leader in enumerate(ids_x):
            has = ~np.isnan(xs[i, :, 0])
            for j, h in enumerate(labels):
                yy = ys[:, has, j]
                xx = np.where(np.isnan(yy), np.nan, xs[i, has, 0][None, :])
                n = (~np.isnan(yy)).sum(axis=1)
                rx, ry = (pd.DataFrame(v).rank(axis=1).to_numpy() for v in (xx, yy))
                with np.errstate(invalid="ignore", divide="ignore"):
                    mid = (n + 1) / 2.0
                    dx, dy = np.nan_to_num(rx - mid[:, None]), np.nan_to_num(ry - mid[:, None])
                    vx, vy = (dx * dx).sum(axis=1), (dy * dy).sum(axis=1)
                    ic = np.where((vx > 0) & (vy > 0), (dx * dy).sum(axis=1) / np.sqrt(vx * vy), np.nan)
                out += [(leader, f, h, c, k) for f, c, k in zip(ids_y, ic, n) if k and f != leader]
        found = pd.DataFrame(out, columns=["leader", "follower", "horizon", "ic", "n_obs"])
        for lo in range(0, len(found), ROWS):
            yield pa.RecordBatch.from_pandas(found.iloc[lo:lo + ROWS], arrow, preserve_index=False)

    return over_pairs(left, right, [x], y, per_block, result, schema, key, by)


def market_corr_by_date(df: DataFrame, x: str, n: int = 30, high: float = 0.7, ts: str = "ts", key: str = "id") -> DataFrame:
    """Mean rolling correlation over all pairs of ids at each date, from per-date sums and without any pair.

    With z the values of an id's last n dates, standardised inside that window, all correlations at a date add up to the
    squares of the sums of z over ids, by position: N ids give (sum_s (sum_i z_is)^2 / (n - 1) - N) / (N (N - 1)). An id
    takes part at a date when it has a value on each of the panel's last n dates and is not constant there. Dates come
    from the data (at most one per calendar day). Work is rows x n; a date sends n sums from each map task.
    """
    rows = df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(key).isNotNull()).select(key, ts, F.col(x).cast("double").alias("_x"))
    grid = rows.select(ts).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(ts)))
    w = Window.partitionBy(key).orderBy("_k").rowsBetween(1 - n, 0)
    d = rows.join(grid, ts).withColumns({"_v": F.collect_list("_x").over(w), "_m": F.avg("_x").over(w), "_s": F.stddev_samp("_x").over(w), "_k0": F.min("_k").over(w)})
    d = d.withColumn("_full", (F.size("_v") == n) & (F.col("_k") - F.col("_k0") == n - 1) & (F.col("_s") > 1e-12 * F.abs("_m")))
    z = [F.sum(F.when(F.col("_full"), (F.get("_v", F.lit(k)) - F.col("_m")) / F.col("_s"))).alias(f"_z{k}") for k in range(n)]
    g = d.groupBy(ts).agg(F.count_if("_full").alias("n_assets"), *z)
    total = sum((F.col(f"_z{k}") * F.col(f"_z{k}") for k in range(1, n)), F.col("_z0") * F.col("_z0")) / (n - 1.0)
    g = g.withColumn("avg_corr", div(total - F.col("n_assets"), F.col("n_assets") * (F.col("n_assets") - 1)))
    return g.select(ts, "avg_corr", "n_assets", F.coalesce(F.col("avg_corr") > high, F.lit(False)).alias("is_high_corr"))
