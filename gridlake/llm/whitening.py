"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Entries become whole numbers, so counts and sums are exact. Each task compresses its centred rows block by
block to a triangle R with R'R = X'X (TSQR); triangles are stacked and compressed again, some at a time,
until one is left. Plane rotations make the columns of R orthogonal: their lengths are the singular
values, and the rotations, accumulated, are the components. No product X'X is formed, so small standard
deviations keep their digits. Only numbers by dimension reach the driver: sums, and one triangle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.llm.common import discard, small_batches, tidy, written

#: Rows of a block, and triangles that one task of a round stacks.
BLOCK_ROWS = 4096
STACK = 32
#: A component whose variance is below this share of the largest is none: rounding alone makes so much.
LEAST_SHARE = 1e-22


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums by dimension, components as rows, standard deviations, shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = x - np.array(self.sums, np.float64) / max(1, self.n)
        return (centred @ self.components.T) / self.deviations


def _whole(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are whole (no null, NaN or infinity), and floor(256 * entry) of each of them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values
    good = flat.is_valid().to_numpy(zero_copy_only=False)
    entries = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    good &= np.isfinite(entries)
    bad = np.concatenate([[0], np.cumsum(~good)])
    keep = (bad[ends[1:]] == bad[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False) & (ends[1:] > ends[:-1])
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(256 * entries), -(2.0**62), 2.0**62).astype(np.int64)
    return keep, [x[a:b] for a, b in zip(ends[:-1][keep], ends[1:][keep], strict=True)]


@tidy
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, rows = _whole(batch.column(0))
        yield pa.record_batch([pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["x"])


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_matrix(batch.column(0)))
        if sum(map(len, held)) >= BLOCK_ROWS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


@tidy
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for x in _blocks(batches):
        n += len(x)
        exact = x.sum(axis=0, dtype=np.int64) if np.abs(x).max(initial=0) < 2**48 else np.array([sum(map(int, c)) for c in x.T], object)
        total = [int(v) + (0 if total is None else total[i]) for i, v in enumerate(exact)]
    if total is not None:
        # halves of 32 bits: their sums stay whole numbers that fit
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([v >> 32 for v in total], pa.int64()), pa.array([v & 0xFFFFFFFF for v in total], pa.int64())], ["dim", "n", "high", "low"])


def triangle(rows: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """R of the rows below an earlier R."""
    stacked = rows if before is None else np.concatenate([before, rows])
    return np.linalg.qr(stacked, mode="r")


def _compressed(mean: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for x in _blocks(batches):
            r = triangle(x - mean, r)
        if r is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return run


def _stacked(d: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))
        r = triangle(np.concatenate([np.frombuffer(x).reshape(-1, d) for _, x in rows]))
        return pa.table({"part": pa.array([rows[0][0] // STACK], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, singular values), falling: rotations of column pairs until all are orthogonal.

    A round rotates disjoint pairs together; d - 1 rounds of a tournament meet every pair. Columns are first
    put in falling order of length, which speeds convergence up.
    """
    d = r.shape[1]
    a = np.array(r, np.float64)
    order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v = a[:, order], np.eye(d)[:, order]
    seats = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[half:][::-1], strict=True) if max(p, q) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, np.int64).reshape(-1, 2).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            turn &= gamma != 0
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            with np.errstate(over="ignore"):  # an endless zeta is no turn
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.linalg.norm(a, axis=0)
    order = np.argsort(-sigma, kind="stable")
    return v[:, order].T, sigma[order]


def fit(fitted: DataFrame, d: int, most: int = 4) -> Whitening:
    """From the distinct vectors of dimension d in column x, as little-endian 64-bit integers."""
    found = fitted.mapInArrow(_sums, "dim int, n long, high long, low long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    n = max((r.n for r in found), default=0)
    sums = [0] * d
    for r in found:
        sums[r.dim] = (r.high << 32) + r.low
    mean = np.array(sums, np.float64) / max(1, n)
    spare = []
    rs = fitted.mapInArrow(_compressed(mean), "part long, r binary")
    parts = fitted.rdd.getNumPartitions()
    while parts > STACK:  # rounds until one task's worth is left
        rs = written(rs, "tsqr")
        spare.append(rs)
        rs = rs.groupBy(F.expr(f"part div {STACK}")).applyInArrow(_stacked(d), "part long, r binary")
        parts = -(-parts // STACK)
    left = rs.collect()  # at most STACK triangles
    discard(*spare)
    if not left:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    r = triangle(np.concatenate([np.frombuffer(x.r).reshape(-1, d) for x in sorted(left, key=lambda x: x.part)]))
    components, sigma = jacobi(r)
    variances = sigma**2 / n
    many = min(most, int((variances > LEAST_SHARE * variances[0]).sum())) if variances[0] > 0 else 0
    return Whitening(n, sums, components[:many], np.sqrt(variances[:many]), variances[:many] / variances.sum() if many else np.zeros(0))


def _moments(model: Whitening):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        total, outer = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches):
            w = model.project(x)
            total, outer = total + w.sum(axis=0), outer + w.T @ w
        i, j = (x.ravel() for x in np.indices((k + 1, k)))
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([outer, total[None]]).ravel())], ["i", "j", "value"])

    return run


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""
    k = len(model.components)
    if not k:
        return 0.0
    rows = fitted.mapInArrow(_moments(model), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    m = np.zeros((k + 1, k))
    for r in rows:
        m[r.i, r.j] = r.value / model.n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sum)^2 by row, exact; None where no long holds it."""
    s = np.array(sums, object)
    most = max(int(np.abs(x).max(initial=0)) * n, *(abs(v) for v in sums), 1) * 2
    if most * most * len(sums) < 2**63:
        gap = n * x - s.astype(np.int64)
        return (gap * gap).sum(axis=1).tolist()
    found = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in found]


def _applied(model: Whitening, error: float, schema: pa.Schema):
    d, k = len(model.sums), len(model.components)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = _whole(batch.column(1))
            fits = np.array([len(r) == d for r in rows], bool)
            at = np.flatnonzero(keep)[fits]
            if not len(at) or not k:
                continue
            x = np.stack([r for r, ok in zip(rows, fits, strict=True) if ok])
            ids = batch.column(0).take(pa.array(np.repeat(at, k)))
            gaps = pa.array(deviation(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
            many = len(at) * k
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(many, model.n)), gaps, pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(many, error))]
            yield pa.record_batch(columns, schema=schema)

    return run


def whiten(df: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null, NaN or infinity are dropped, and so are those of another
    dimension than most distinct vectors have (of equals the smallest). Repeated vectors count once in the
    fit and each gets its rows. Without any spread (no, one or equal vectors) there are no components and so
    no rows. deviation is null where no long holds it. Null ids stay; other columns are left behind.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    vectors = df.select(F.col(vector_col).cast("array<double>").alias("v"))
    fitted = written(vectors.mapInArrow(_keys, "x binary").distinct(), "whitening")
    dims = fitted.groupBy((F.octet_length("x") / 8).cast("int").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = dims.d if dims else 0
    own = fitted.where(F.octet_length("x") == 8 * d)
    model = fit(own, d, most) if d else Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    error = identity_error(own, model)
    discard(fitted)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    return df.select(F.col(id_col), F.col(vector_col).cast("array<double>")).mapInArrow(_applied(model, error, to_arrow_schema(out)), out)
