"""Embedding whitening by incremental eigendecomposition.

Entries become longs x = floor(64 c) + 1000000. Every partition keeps the spectrum of its own centred scatter: a new vector adds
the rank-one term n w / (n + w) (x - mean)(x - mean)' (w: how often the batch holds the vector). ``rank_one`` finds the new
eigenvalues as roots of the secular equation between the old ones, by a rational step that fits both neighbouring poles;
entries without weight are deflated and equal poles are turned into one by a reflection. Eigenvectors come from weights that are
recomputed from the roots, so they stay orthogonal. Spectra of partitions are combined in a tree of ``FAN`` states each: every
eigenpair of one is a rank-one update of the other, then one update moves the means together. A last distributed pass refines the
result: the centred covariance is projected on the basis (Rayleigh-Ritz) and its small eigenproblem solved.

No row passes through the driver: it sees one spectrum (d x d) for each vector length. Sums S, counts and ``deviation`` are exact.

Defined results. Null vectors, empty ones and those with null or non-finite entries are dropped. Vectors of each length are a fit
list of their own. Components stop at ``most`` and where the variance is nothing but rounding (below d * 1e-13 of the trace): one
vector, or equal vectors, have no component and give no row. Repeated rows (and null ids) count and return each on its own. A
``deviation`` beyond 63 bits is null. Scaled entries beyond 2^52 are cut to that. Equal eigenvalues: any basis of their space, the
same for all rows. Only the two named columns are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ragged, scratch

SCALE, SHIFT = 64, 1_000_000
#: States that are combined in one task, vectors of one matrix product, and output rows of one batch.
FAN, BLOCK, OUT = 16, 4096, 65_536
EPS = np.finfo(np.float64).eps
STATE = "d int, part long, n long, total array<bigint>, mean array<double>, values array<double>, basis array<double>"


def secular(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum w_i / (d_i - x), one above each pole, as (pole number, offset from that pole). ``d`` ascends, w > 0."""
    k = len(d)
    origin, ends = np.arange(k), np.append(d[1:], d[-1] + w.sum())
    if k == 1:
        return origin, w.copy()
    mid = (d + ends) / 2
    with np.errstate(divide="ignore", over="ignore"):
        above = 1 + (w[:, None] / (d[:, None] - mid)).sum(axis=0) >= 0
    origin[:-1] += ~above[:-1]
    delta = d[:, None] - d[origin]
    gap = ends - d
    low = np.where(origin == np.arange(k), 0.0, -gap / 2)
    high = np.where(origin == np.arange(k), np.append(gap[:-1] / 2, gap[-1]), 0.0)
    left, right = np.diagonal(delta), np.append(np.diagonal(delta, -1), 0.0)
    before = np.triu(np.ones((k, k)))
    t = (low + high) / 2
    last = np.arange(k) == k - 1
    for _ in range(60):
        diff = delta - t
        term = w[:, None] / diff
        slope = term / diff
        psi, dpsi = (term * before).sum(axis=0), (slope * before).sum(axis=0)
        phi, dphi = (term * (1 - before)).sum(axis=0), (slope * (1 - before)).sum(axis=0)
        f = 1 + psi + phi
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        q, s = dpsi * (left - t) ** 2, dphi * (right - t) ** 2
        a = 1 + psi - dpsi * (left - t) + phi - dphi * (right - t)
        with np.errstate(divide="ignore", invalid="ignore"):
            b = a * (left + right) + q + s
            new = 2 * (q * right + s * left) / (b + np.sqrt(np.maximum(b * b - 4 * a * (q * right + s * left), 0)))
            new = np.where(last, q / a, new)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(new - t) <= 4 * EPS * np.abs(new)) | (np.abs(f) <= EPS * (1 + 4 * (np.abs(psi) + np.abs(phi)) + np.abs(t) * (dpsi + dphi)))
        t = np.where(done, t, new)
        if done.all():
            break
    return origin, t


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis diag(values) basis' + rho v v'`` (rho >= 0), values ascending. ``basis`` may be changed in place."""
    z = basis.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, basis
    z, rho = z / np.sqrt(size), rho * size
    tiny = 8 * EPS * max(float(values[-1]), rho)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values) > tiny) + 1, [len(values)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:  # equal poles: a reflection gives all their weight to the last
            h = z[a:b].copy()
            length = float(np.sqrt(h @ h))
            if length:
                end = -length if h[-1] >= 0 else length
                h[-1] -= end
                basis[:, a:b] -= np.outer(basis[:, a:b] @ h, h * (2 / float(h @ h)))
                z[a:b] = 0
                z[b - 1] = end
    live = np.flatnonzero(rho * np.abs(z) > tiny)
    if not len(live):
        return values, basis
    d, weight = values[live], z[live]
    origin, offset = secular(d, rho * weight**2)
    diff = (d[:, None] - d[origin]) - offset  # d_i - root_k, exact to the last places
    gaps = d[:, None] - d
    np.fill_diagonal(gaps, 1.0)
    weight = np.copysign(np.sqrt(np.abs(np.prod(diff / gaps, axis=1))), weight)
    turn = weight[:, None] / diff
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values = values.copy()
    values[live] = d[origin] + offset
    basis[:, live] = basis[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, exact sums, mean and eigenpairs of the scatter of vectors of one length."""

    def __init__(self, d: int):
        self.n, self.total, self.mean = 0, np.zeros(d, np.int64), np.zeros(d)
        self.values, self.basis = np.zeros(d), np.eye(d)

    def add(self, y: np.ndarray, times: int) -> None:
        v = y - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, v, self.n * times / (self.n + times))
        self.n += times
        self.total += y * times
        self.mean = self.mean + v * (times / self.n)

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.__dict__.update(other.__dict__)
            return
        for value, u in zip(other.values.tolist(), other.basis.T):
            self.values, self.basis = rank_one(self.values, self.basis, u, value)
        v, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one(self.values, self.basis, v, self.n * other.n / n)
        self.mean = self.mean + v * (other.n / n)
        self.total = self.total + other.total
        self.n = n

    def row(self, part: int) -> tuple:
        return len(self.mean), part, self.n, self.total, self.mean, self.values, self.basis.ravel()

    @classmethod
    def of(cls, row) -> Spectrum:
        s = cls(row.d)
        s.n, s.total = int(row.n), np.array(row.total, np.int64)
        s.mean, s.values, s.basis = np.array(row.mean, float), np.array(row.values, float), np.array(row.basis, float).reshape(row.d, row.d)
        return s


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, entries minus ``SHIFT`` as longs) of the vectors of a batch, ``BLOCK`` at once."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            entries = flat[ragged(offsets[:-1][some], sizes[some])[1]].reshape(len(some), d)
            yield int(d), some, np.clip(np.floor(SCALE * entries), -(2.0**52), 2.0**52).astype(np.int64)


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("vector"))


def spectra(fit: DataFrame) -> dict[int, Spectrum]:
    """Combined spectrum of each vector length."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spectrum] = {}
        for batch in batches:
            for d, _, y in by_length(batch.column(0)):
                state = held.setdefault(d, Spectrum(d))
                for x, times in zip(*np.unique(y, axis=0, return_counts=True)):
                    state.add(x, int(times))
        part = TaskContext.get().partitionId()
        for state in held.values():
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(state.row(part), types)], names=[f.split()[0] for f in STATE.split(", ")])

    def combine(states: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for row in states.sort_values("part").itertuples():
            one = Spectrum.of(row)
            if whole is None:
                whole = one
            else:
                whole.merge(one)
        return pd.DataFrame([whole.row(int(states["part"].min()) // FAN)], columns=states.columns)

    states = scratch(fit.select("vector").mapInArrow(grow, STATE))
    while (states.agg(F.max("part")).first()[0] or 0) > 0:
        states = scratch(states.groupBy("d", F.floor(F.col("part") / FAN)).applyInPandas(combine, STATE))
    return {row.d: Spectrum.of(row) for row in states.collect()}


def gram(fit: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of products of the centred vectors on each length's directions, with their sums in the last row. ``models``: mean, directions."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: np.zeros((w.shape[1] + 1, w.shape[1])) for d, (_, w) in models.items()}
        for batch in batches:
            for d, _, y in by_length(batch.column(0)):
                mean, w = models[d]
                p = (y - mean) @ w
                held[d] += np.vstack((p.T @ p, p.sum(axis=0)))
        for d, g in held.items():
            g = g.ravel()
            for a in range(0, len(g), OUT):
                some = g[a : a + OUT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array(np.arange(a, a + len(some))), pa.array(some)], names=["d", "k", "v"])

    sums = fit.select("vector").mapInArrow(products, "d int, k long, v double").groupBy("d", "k").agg(F.sum("v").alias("v"))
    out = {d: np.zeros((w.shape[1] + 1) * w.shape[1]) for d, (_, w) in models.items()}
    for r in sums.collect():
        out[r.d][r.k] = r.v
    return {d: g.reshape(models[d][1].shape[1] + 1, -1) if len(g) else np.zeros((1, 0)) for d, g in out.items()}


def deviations(y: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact sum of (n y - total)^2 of each row."""
    reach = max(int(np.abs(y).max(initial=0)), 1) * n + int(np.abs(total).max(initial=0))
    if reach < 1 << 62 and reach * reach * y.shape[1] < 1 << 63:
        return ((n * y - total) ** 2).sum(axis=1).tolist()
    exact = ((n * y.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector that takes part and component."""
    fit = fit_list(vectors, id_col, vector_col)
    first = spectra(fit)
    means = {d: s.total / s.n for d, s in first.items()}
    bases = {d: (means[d], np.linalg.qr(s.basis)[0]) for d, s in first.items()}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, g in gram(fit, bases).items():
        n = first[d].n
        centre = g[-1] / n
        e, turn = np.linalg.eigh(g[:-1] / n - np.outer(centre, centre))
        keep = np.flatnonzero(e > d * 1e-13 * max(e.sum(), 0.0))[::-1][:most]
        found[d] = (bases[d][1] @ turn[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum() if len(keep) else e[keep])
    error = {}
    for d, g in gram(fit, {d: (means[d], w) for d, (w, _) in found.items()}).items():
        centre = g[-1] / first[d].n
        error[d] = float(np.abs(g[:-1] / first[d].n - np.outer(centre, centre) - np.eye(len(centre))).max(initial=0.0))
    totals = {d: (s.n, s.total) for d, s in first.items()}
    id_type = fit.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, y in by_length(batch.column(1)):
                (n, total), (w, explained) = totals[d], found[d]
                k = w.shape[1]
                if not k:
                    continue
                step = max(1, OUT // k)
                for a in range(0, len(rows), step):
                    part = y[a : a + step]
                    ids = batch.column(0).take(pa.array(np.repeat(rows[a : a + step], k)))
                    apart = pa.array(deviations(part, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(part)), k)))
                    size = len(part) * k
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(size, n)), apart,
                            pa.array(((part - means[d]) @ w).ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(size, error[d])),
                        ],
                        names=[f.split()[0] for f in OUTPUT.split(", ")],
                    )

    return fit.mapInArrow(project, OUTPUT.replace("vec_id long", f"vec_id {id_type}"))
