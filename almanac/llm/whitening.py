"""Whitening of embeddings, by eigenvectors in mixed precision.

Vectors are put on a grid of integers, ``floor(256 c)``. Sums and the covariance of the distinct
grid vectors are exact: each task centres its rows by the nearest integers to the mean, multiplies,
and emits sums of integers, which Spark adds up as decimals; the rest of the mean is taken off in
whole numbers. What comes to the driver has the square of the dimensions, whatever the rows.

Eigenvectors of that matrix are found in float32 and corrected by the iteration of Ogita and
Aishima, which needs matrix products only and squares the error each time, in extended precision.
Eigenvalues that are too close for it are a cluster: their vectors span the right space, and are
told apart by a solve of the matrix projected on them, shifted by their mean and scaled, so that
differences far below the eigenvalues count. What is left is the rounding of extended precision (5e-20
where it has 80 bits) over the gap to the nearest eigenvalue, relative to the largest one.

Defined results: rows whose vector is missing or holds a missing or non-finite entry, or one too
large for the grid, are left out; a shorter vector counts as ending in zeros, an empty one as zero.
Repeated rows each get their result but are in the fit once; a row without an id gets one without.
Components whose eigenvalue is zero (to rounding) cannot be whitened and are left out: a table
without two different vectors gives no rows, as an empty one does. Only the named columns are read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import stored

GRID = 256
COMPONENTS = 4
#: Corrections at most; each squares the error, so a few are enough or none are.
CORRECTIONS = 20
_WIDE = np.longdouble
_SUM = "decimal(38,0)"


def _grid(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their grid vectors."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * GRID
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if size.max(initial=0) > width:
        raise ValueError(f"a vector is longer than the {width} dimensions that were fitted")
    row = np.repeat(np.arange(len(size)), size)
    fine = np.abs(values) < 2.0**62  # not so if it is not finite
    remain = vectors.is_valid().to_numpy(zero_copy_only=False)
    remain &= np.bincount(row[~fine], minlength=len(size)) == 0
    out = np.zeros((len(size), width), np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[fine], place[fine]] = np.floor(values[fine]).astype(np.int64)
    return remain, out[remain]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(
        pa.list_(pa.int64())
    )


def _decimals(numbers) -> pa.Array:
    return pa.array([decimal.Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def exact_sums(rows: np.ndarray) -> np.ndarray:
    if rows.size and float(np.abs(rows).max()) * len(rows) >= 2.0**62:
        rows = rows.astype(object)
    return rows.sum(axis=0).astype(object)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` of integers, without rounding."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    if most < 2.0**53:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64).astype(object)
    if most < 2.0**62:
        return (a.T @ b).astype(object)
    return a.astype(object).T @ b.astype(object)


def distinct_grid(vectors: DataFrame, width: int) -> DataFrame:
    """``(x)``: each grid vector once."""

    def on_grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _grid(batch.column(0), width)
            yield pa.record_batch([_lists(x)], ["x"])

    return vectors.mapInArrow(on_grid, "x array<long>").distinct()


def _sums(fit: DataFrame, width: int) -> list[int]:
    """By dimension, of all vectors."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total = total + exact_sums(_grid_rows(batch, width))
        yield pa.record_batch([pa.array(range(width), pa.int32()), _decimals(total)], ["i", "s"])

    parts = fit.mapInArrow(of_partition, f"i int, s {_SUM}")
    total = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return [total.get(i, 0) for i in range(width)]


def _grid_rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(-1, width)


def _products(fit: DataFrame, width: int, centre: list[int]) -> np.ndarray:
    """Sums of products of all pairs of dimensions, after the centre was taken off."""
    upper = np.triu_indices(width)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((width, width), object), np.array(centre, np.int64)
        for batch in batches:
            own = _grid_rows(batch, width) - middle
            total = total + exact_products(own, own)
        columns = [pa.array(u, pa.int32()) for u in upper]
        yield pa.record_batch([*columns, _decimals(total[upper])], ["i", "j", "s"])

    parts = fit.mapInArrow(of_partition, f"i int, j int, s {_SUM}")
    out = np.zeros((width, width), object)
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["s"])
    return out


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Numbers of values of which each is within ``least`` of the next, two or more together."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > least) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _told_apart(a: np.ndarray, x: np.ndarray, cluster: np.ndarray) -> None:
    """Solve within the space of a cluster."""
    own = x[:, cluster]
    image = a @ own
    middle = (own * image).sum() / (own * own).sum()
    inner = own.T @ (image - middle * own)
    inner = (inner + inner.T) / 2
    size = np.abs(inner).max()
    if size > 4 * len(a) * np.finfo(_WIDE).eps:  # else the eigenvalues are equal
        _, turn = np.linalg.eigh((inner / size).astype(float))
        x[:, cluster] = own @ turn.astype(_WIDE)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix in extended
    precision."""
    a = np.asarray(a, _WIDE)
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(d, _WIDE), np.eye(d, dtype=_WIDE)
    scale = _WIDE(2) ** np.ceil(np.log2(scale))
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    size, last = np.sqrt((a * a).sum()), np.inf
    for _ in range(CORRECTIONS):
        r = np.eye(d, dtype=_WIDE) - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap spoils right angles
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        least = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= least
        change = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ change
        for cluster in _clusters(values, least):
            _told_apart(a, x, cluster)
        most = np.abs(change).max()
        if most < 1e-9 and most >= last / 2 or most < 4 * np.finfo(_WIDE).eps:
            break
        last = most
    x = x + x @ (np.eye(d, dtype=_WIDE) - x.T @ x) / 2  # after the solves, which are double
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    if np.abs(a @ x - x * values).max() > 1e-13 or np.abs(x.T @ x - np.eye(d)).max() > 1e-13:
        raise ArithmeticError("the eigenvectors did not settle")
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.sqrt((x * x).sum(axis=0))


@dataclass
class Whitening:
    """Of ``n`` distinct grid vectors with sums ``sums``: components as columns, their eigenvalues,
    and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of grid vectors. The whole part of the mean is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of ``(n x - sums) ** 2``, exactly."""
        n, rest = self.n, [s % self.n for s in self.sums]
        own = x - np.array([s // n for s in self.sums], np.int64)
        if float(np.abs(own).max(initial=0)) * max(n, float(np.abs(own).max(initial=0))) * len(rest) >= 2.0**62:
            own = own.astype(object)
        squares = (own * own).sum(axis=1).tolist()
        cross = (own @ np.array(rest, own.dtype)).tolist()
        last = sum(r * r for r in rest)
        return [n * n * q - 2 * n * c + last for q, c in zip(squares, cross, strict=True)]


def _vector(column: str) -> Column:
    return F.col(column).cast("array<double>").alias("v")


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening:
    """Learn from all vectors, each distinct one once."""
    picked = vectors.select(_vector(vector_col))
    width = picked.agg(F.max(F.size("v"))).first()[0] or 0
    if width < 1:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    grid = stored(distinct_grid(picked, width), "grid")
    n = grid.count()
    if n == 0:
        return Whitening(0, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0)
    sums = _sums(grid, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    exact = n * _products(grid, width, centre) - np.outer(rest, rest)
    covariance = np.array([[_WIDE(int(v)) for v in row] for row in exact], _WIDE) / _WIDE(n) / _WIDE(n)
    values, own = eigen(covariance)
    trace = np.trace(covariance)
    least = trace * width * 2.0**-52
    k = int((values[:components] > least).sum())
    found = Whitening(
        n, sums, own[:, :k].astype(float), values[:k].astype(float), float(trace)
    )
    found.identity_error = _identity_error(grid, found, width)
    return found


def _identity_error(grid: DataFrame, w: Whitening, width: int) -> float:
    """Largest entry of the covariance of what the fit list becomes, less the identity."""
    k = w.components.shape[1]
    row, column = np.triu_indices(k)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            own = w.project(_grid_rows(batch, width))
            sums += own.sum(axis=0)
            products += own.T @ own
        at = [np.concatenate([np.arange(k), row]), np.concatenate([np.full(k, -1), column])]
        total = np.concatenate([sums, products[row, column]])
        columns = [pa.array(a, pa.int32()) for a in at]
        yield pa.record_batch([*columns, pa.array(total, pa.float64())], ["i", "j", "s"])

    parts = grid.mapInArrow(of_partition, "i int, j int, s double")
    total = {
        (r["i"], r["j"]): r["s"] / w.n
        for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    }
    return max(
        (
            abs(total[i, j] - total[i, -1] * total[j, -1] - (i == j))
            for i, j in zip(row.tolist(), column.tolist(), strict=True)
        ),
        default=0.0,
    )


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def whiten(vectors: DataFrame, w: Whitening, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component. ``deviation`` is null where it is beyond a
    long. The fitted whitening, of the size of the components, is sent to the tasks."""
    sent = vectors.sparkSession.sparkContext.broadcast(w)
    k = w.components.shape[1]

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        explained = w.values / w.trace if k else w.values
        for batch in batches:
            remain, x = _grid(batch.column(1), len(w.sums))
            ids = batch.column(0).filter(pa.array(remain))
            deviation = [v if v < 2**63 else None for v in w.deviations(x)]
            projected = w.project(x)
            for c in range(k):
                rows = len(x)
                yield pa.record_batch(
                    [
                        ids, pa.array(np.full(rows, c + 1, np.int32)), pa.array(np.full(rows, w.n)),
                        pa.array(deviation, pa.int64()), pa.array(projected[:, c]),
                        pa.array(np.full(rows, explained[c])),
                        pa.array(np.full(rows, w.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _vector(vector_col))
    if k == 0:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return picked.mapInArrow(of_partition, SCHEMA)
