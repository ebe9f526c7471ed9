"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three fast Hadamard transforms with random signs (zeros fill up to a power of two) and falls in
the bucket of its nearest signed axis. ``tables`` such hashes are kept; a query probes the ``probes`` nearest axes of each, all
vectors of these buckets are candidates and are ranked by their exact cosine in double precision. With ``last`` > 0 a
second turn's nearest signed axis among the first ``last`` coordinates divides every bucket further, for larger tables.

``calibrate`` fits probes and ``last`` for each vector length on a bounded sample: ``sample`` queries are answered exactly by one scan of all
vectors of their length, and the cheapest setting that finds ``recall`` of these true neighbours is taken. Lengths with fewer than
``ENOUGH`` queries in the sample are searched in all buckets. All vectors are indexed. A query that found fewer than k, though there are
more candidates of its length, is searched again in all buckets of one table, which hold every vector once: each query gets
min(k, candidates) rows.

Equal vectors are one index entry with their k + 1 smallest ids (no other id of them can be among k nearest). A bucket
is dealt to tasks in blocks of about ``BLOCK`` vectors which queries pass as a stream, so neither side of a hot bucket has to fit in
memory. Each (query, block) gives its k + 1 best only.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
vectors are compared with those of their own length only. Equal rows count once. Ties go to the smaller id. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import scratch

TABLES, SEED = 8, 7
BLOCK = 4096
SECOND = (0, 1, 4, 16)
#: Sampled queries of a length that are enough to fit its setting, and the setting (all buckets, one turn) of a length with fewer.
ENOUGH, ALL = 16, (1 << 30, 0)
Settings = dict[int, tuple[int, int]]


def hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    h = 1
    while h < size:
        pairs = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, size) / np.sqrt(size)


@lru_cache(256)
def signs(dim: int, table: int) -> np.ndarray:
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([SEED, dim, table]).choice([-1.0, 1.0], (6, size))


def turned(unit: np.ndarray, table: int, second: bool = False) -> np.ndarray:
    s = signs(unit.shape[1], table)
    x = np.zeros((len(unit), s.shape[1]))
    x[:, : unit.shape[1]] = unit
    for k in range(3):
        x = hadamard(x * s[3 * second + k])
    return x


def nearness(x: np.ndarray) -> np.ndarray:
    """How near each signed axis is: axis j is column 2j, its opposite 2j + 1."""
    return np.stack((x, -x), axis=2).reshape(len(x), -1)


def bucket_scores(unit: np.ndarray, table: int, last: int) -> np.ndarray:
    first = nearness(turned(unit, table))
    if not last:
        return first
    rest = nearness(turned(unit, table, True)[:, :last])
    return (first[:, :, None] + rest[:, None, :]).reshape(len(unit), -1)


def buckets(unit: np.ndarray, table: int, last: int) -> np.ndarray:
    first = nearness(turned(unit, table)).argmax(axis=1)
    if not last:
        return first
    return first * 2 * last + nearness(turned(unit, table, True)[:, :last]).argmax(axis=1)


def units(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def unpack(rows: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def packed(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """id, dim, vec (bytes) of the vectors that take part, and the numpy type of vec."""
    kind = "<f4" if "float" in dict(table.dtypes)[vec_col] else "<f8"
    schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array([np.nan if c is None else c for c in v.as_py()], kind) + np.array(0, kind)  # no negative zeros
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    some = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    return some.mapInArrow(pack, "id long, dim int, vec binary"), kind


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def best_in(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of c for each of q: exact cosines, ties to the smaller id."""
    score = (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1))
    if score.shape[1] > 4 * k:  # everything at least as near as the k-th
        floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        r, s = np.nonzero(score >= floor[:, None])
    else:
        r, s = np.divmod(np.arange(score.size), max(1, score.shape[1]))
    order = np.lexsort((c_ids[s], -score[r, s], r))
    r, s = r[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    r, s = r[rank < k], s[rank < k]
    return q_ids[r], c_ids[s], score[r, s]


PAIR = "q long, c long, score double"
PAIRS = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])


def exact(entries: DataFrame, asked: list[tuple[int, bytes]], dim: int, kind: str, k: int) -> DataFrame:
    """q, c, score of the k nearest entries of a bounded list of queries, by one scan."""
    sent = entries.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = np.array([i for i, _ in sent.value]), unpack([v for _, v in sent.value], kind)
        for batch in batches:
            if batch.num_rows:
                found = best_in(q_ids, q, batch.column(0).to_numpy(), unpack(batch.column(1).to_pylist(), kind), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=PAIRS)

    return top_pairs(entries.where(F.col("dim") == dim).select("key", "vec").mapInArrow(scan, PAIR), k)


def calibrate(entries: DataFrame, asked: DataFrame, kind: str, *, k: int, tables: int = TABLES, recall: float = 0.97, sample: int = 96) -> Settings:
    """(probes, last) of the cheapest setting for each length with enough sampled queries."""
    rows = asked.orderBy(F.xxhash64("key"), "key").limit(sample).select("key", "dim", "vec").collect()
    found: Settings = {}
    for dim in sorted({r.dim for r in rows}):
        few = [(r.key, bytes(r.vec)) for r in rows if r.dim == dim]
        if len(few) < min(ENOUGH, len(rows)):
            continue
        true = exact(entries, few, dim, kind, k + 1).where("q <> c")
        pairs = true.join(entries.select(F.col("key").alias("c"), F.col("vec").alias("v")), "c").select("q", "v").collect()
        if pairs:
            found[dim] = cheapest(dict(few), pairs, kind, dim, entries.where(F.col("dim") == dim).count(), tables, recall)
    return found


def cheapest(own: dict[int, bytes], pairs: list, kind: str, dim: int, n: int, tables: int, recall: float) -> tuple[int, int]:
    q, c = units(unpack([own[p.q] for p in pairs], kind)), units(unpack([bytes(p.v) for p in pairs], kind))
    best = None
    for last in SECOND:
        if last > signs(dim, 0).shape[1]:
            continue
        need = np.full(len(pairs), np.iinfo(np.int64).max)  # nearer buckets than the neighbour's, in the best table
        for t in range(tables):
            score = bucket_scores(q, t, last)
            at = score[np.arange(len(pairs)), buckets(c, t, last)]
            need = np.minimum(need, (score > at[:, None]).sum(axis=1))
        probes = int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1
        total = score.shape[1]
        cost = tables * probes * (n / total + 64)  # compared vectors, and what a probe costs beside them
        if best is None or cost < best[0]:
            best = cost, probes, last
    return best[1:]


def coded(rows: DataFrame, key: str, kind: str, tables: int, settings: Settings, probe: bool) -> DataFrame:
    """t, b, key, vec: each vector in the bucket (``probe``: the nearest buckets that its length's setting names) of every table. A length
    without a setting has one table, of which all buckets are probed."""
    schema = pa.schema([("dim", pa.int32()), ("t", pa.int32()), ("b", pa.int32()), ("key", pa.int64()), ("vec", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                for dim in set(part.column(1).to_pylist()):
                    some = part.filter(pa.compute.equal(part.column(1), dim))
                    unit = units(unpack(some.column(2).to_pylist(), kind))
                    probes, last = settings.get(dim, ALL)
                    for t in range(tables if dim in settings else 1):
                        if not probe:
                            b = buckets(unit, t, last)[:, None]
                        else:
                            score = bucket_scores(unit, t, last)
                            b = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                        at = pa.array(np.repeat(np.arange(len(unit)), b.shape[1]))
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(b.ravel().astype(np.int32)), some.column(0).take(at), some.column(2).take(at)], schema=schema)

    return rows.select(F.col(key).alias("key"), "dim", "vec").mapInArrow(emit, "dim int, t int, b int, key long, vec binary")


def search_buckets(base: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """q, c, score: the k best of every block of every probed bucket."""
    sizes = base.groupBy("dim", "t", "b").count().select(F.col("dim").alias("d_"), F.col("t").alias("t_"), F.col("b").alias("b_"), F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    on = (F.col("dim") == F.col("d_")) & (F.col("t") == F.col("t_")) & (F.col("b") == F.col("b_"))
    split = sizes.where("n > 1")
    left = base.join(split, on, "left").select("dim", "t", "b", F.when(F.col("n") > 1, F.pmod(F.xxhash64("key"), F.col("n"))).otherwise(0).cast("int").alias("block"), F.lit(0).alias("side"), "key", "vec")
    right = asked.join(split, on, "left").select("dim", "t", "b", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("block"), F.lit(1).alias("side"), "key", "vec")
    group = ["dim", "t", "b", "block"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, held = None, [], [], None

        def answer(q_ids: list[int], qs: list[bytes]) -> pa.RecordBatch:
            found = best_in(np.array(q_ids), unpack(qs, kind), *held, k)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=PAIRS)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group)))
            side, key, vec = (batch.column(c).to_pylist() for c in ("side", "key", "vec"))
            q_ids, qs = [], []
            for g, s, i, v in zip(keys, side, key, vec):
                if g != now:
                    if q_ids:
                        yield answer(q_ids, qs)
                    now, ids, rows, held, q_ids, qs = g, [], [], None, [], []
                if s == 0:
                    ids.append(i)
                    rows.append(v)
                elif ids:
                    if held is None:
                        held = np.array(ids), unpack(rows, kind)
                        rows = []
                    q_ids.append(i)
                    qs.append(v)
                    if len(qs) >= 512:
                        yield answer(q_ids, qs)
                        q_ids, qs = [], []
            if q_ids:
                yield answer(q_ids, qs)

    dealt = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "side")
    return dealt.mapInArrow(rank, PAIR)


def nearest(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, tables: int = TABLES, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest rows of each query row. ``is_query``: a condition on column ``id``."""
    rows, kind = packed(table, id_col, vec_col)
    rows = scratch(rows.distinct())
    order = Window.partitionBy("dim", "vec").orderBy("id")
    firsts = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    entries = scratch(firsts.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("key", F.col("ids")[0]))
    if rows.count() != entries.count() and entries.groupBy("key").count().where("count > 1").limit(1).count():
        # one id with several vectors: entries need numbers of their own
        entries = scratch(entries.withColumn("key", F.xxhash64("key", "vec")))
    queries = scratch(rows.where(is_query).select(F.col("id").alias("query_id"), "dim", "vec").join(entries.select("dim", "vec", "key"), ["dim", "vec"]).select("query_id", "key"))
    asked = scratch(entries.join(queries.select("key").distinct(), "key", "left_semi").select("key", "dim", "vec"))
    settings = calibrate(entries, asked, kind, k=k, tables=tables, recall=recall)
    pairs = search_buckets(coded(entries, "key", kind, tables, settings, False), coded(asked, "key", kind, tables, settings, True), kind, k + 1)
    best = scratch(top_pairs(pairs.groupBy("q", "c").agg(F.max("score").alias("score")), k + 1))
    # copies count as often as they have ids; a query's own id is among those found and among those of its length
    copies = entries.select(F.col("key").alias("c"), F.size("ids").alias("ids"))
    reached = best.join(copies, "c").groupBy(F.col("q").alias("key")).agg(F.sum("ids").alias("reached"))
    whole = entries.groupBy("dim").agg(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("wanted"))
    short = asked.join(reached, "key", "left").join(whole, "dim").where(F.coalesce("reached", F.lit(0)) < F.col("wanted")).select("key", "dim", "vec")
    short = scratch(short)
    if short.limit(1).count():
        again = search_buckets(coded(entries.join(short.select("dim").distinct(), "dim", "left_semi"), "key", kind, 1, {}, False), coded(short, "key", kind, 1, {}, True), kind, k + 1)
        best = top_pairs(best.union(again).groupBy("q", "c").agg(F.max("score").alias("score")), k + 1)
    named = best.join(entries.select(F.col("key").alias("c"), "ids"), "c").select("q", F.explode("ids").alias("c"), "score")
    named = top_pairs(named, k + 1)
    final = queries.join(named, queries.key == named.q).where("query_id <> c")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "c"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("c").alias("vec_id"), "score")
