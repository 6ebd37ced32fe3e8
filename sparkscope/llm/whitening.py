"""Whitening of embeddings: streamed covariance, merged states, symmetric QR.

1. Entries become integers, and each distinct vector counts once (the fit list).
2. Every partition of the fit list keeps a Welford state: number, mean, and sum
   of outer products of deviations, updated by one rank-one term a vector, so
   that nothing is squared before it is centred. The integer sums go along.
3. States are merged by the parallel update formula, ``MERGED`` at a time in
   tasks and level by level, until so few are left; the driver merges these.
4. The covariance is made tridiagonal by reflections and solved by QR steps
   with implicit shifts, on the driver: its size is the vectors' width.
5. Rows are projected in Arrow batches. A second pass of Welford states over
   the whitened fit list gives what its covariance lacks to the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.session import materialise, workers_see_package

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components at most, and states that a task or the driver merges.
COMPONENTS, MERGED = 16, 16
_STATE = "slot long, n long, sums binary, mean binary, outer binary"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


@dataclass
class State:
    """Welford state of some vectors: their number, exact sums, mean, and sum of outer products of deviations from it."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    outer: np.ndarray

    @classmethod
    def empty(cls, width: int) -> State:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.zeros((width, width)))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.outer += np.multiply.outer(before, x - self.mean)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        apart = other.mean - self.mean
        outer = self.outer + other.outer + np.multiply.outer(apart, apart) * (self.n * (other.n / n))
        return State(n, self.sums + other.sums, self.mean + apart * (other.n / n), outer)

    def row(self, slot: int) -> pa.RecordBatch:
        values = [slot, self.n, self.sums.tobytes(), self.mean.tobytes(), self.outer.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], _NAMES)


def _states(rows: pa.Table | pa.RecordBatch) -> Iterator[State]:
    of = lambda v, t: np.frombuffer(v.as_buffer(), t)
    for n, sums, mean, outer in zip(*(rows[c] for c in _NAMES[1:]), strict=True):
        mean_ = of(mean, np.float64)
        yield State(n.as_py(), of(sums, np.int64), mean_, of(outer, np.float64).reshape(len(mean_), -1))


def _merge(states: Iterable[State]) -> State | None:
    total = None
    for state in states:
        total = state if total is None else total.merged(state)
    return total


def _welford(rows: DataFrame, column: str, width: int, values: np.dtype) -> State | None:
    """The state of all vectors of a column of packed values; None if there are none."""

    def partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State.empty(width)
        for batch in batches:
            x = np.frombuffer(b"".join(batch[column].to_pylist()), values).reshape(-1, width)
            if values == np.int64:
                state.sums += x.sum(axis=0)
            for row in x.astype(np.float64):
                state.add(row)
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    def together(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_merge(_states(group)).row(group["slot"][0].as_py())])

    states = materialise(rows.select(column).mapInArrow(partition, _STATE))
    left = states.count()
    while left > MERGED:
        left = math.ceil(left / MERGED)
        states = materialise(states.withColumn("slot", F.pmod("slot", F.lit(left))).groupBy("slot").applyInArrow(together, _STATE), replaces=states)
    return _merge(_states(states.orderBy("slot").toArrow().combine_chunks()))  # MERGED states at most


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, what is beside it, q) with q.T @ a @ q tridiagonal: one reflection a column."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0:
            continue
        v = x.copy()
        v[0] += math.copysign(length, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by implicitly shifted QR."""
    n = len(a)
    d, e, q = _tridiagonal((a + a.T) / 2)
    q = q.T.copy()  # rows are faster to turn
    high, rounds = n - 1, 0
    while high > 0:
        small = np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= small] = 0
        if e[high - 1] == 0:
            high, rounds = high - 1, 0
            continue
        rounds += 1
        if rounds > 60:
            raise ArithmeticError("an eigenvalue has not settled")
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        # the eigenvalue of the last two rows that is nearer to the last entry
        gap = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (gap + math.copysign(math.hypot(gap, e[high - 1]), gap))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order].T
    # each to length one and with its largest entry positive, so that runs agree
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return d[order], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])


@dataclass
class Whitening:
    """What a fit gives: exact sums of n vectors, and for each component its vector, eigenvalue and share of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        apart = self.n * x - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * max(1, x.shape[1]) >= 1 << 63:
            raise OverflowError("squared deviations do not fit into 64 bits")
        return (apart * apart).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # n * x - S is an exact integer, so the mean costs no digits
        return ((self.n * x - self.sums) / self.n) @ self.components / np.sqrt(self.eigenvalues)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id long, x binary) of rows without nulls or non-finite entries, and the width: int64 entries, shorter vectors padded by the value of zero."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            for i, row in enumerate(batch["v"]):
                x[i, : len(row)] = row.values.to_numpy()
            whole = np.floor(SCALE * x)
            if np.abs(whole).max(initial=0) >= 1 << 53:
                raise OverflowError("entries of these vectors are too large for exact integers")
            packed = [r.tobytes() for r in whole.astype(np.int64) + SHIFT]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(packed, pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x binary"), width


def fit_whitening(points: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The fit over distinct vectors (x binary); None without any. Components whose eigenvalue is zero to working precision are left out."""
    state = _welford(points, "x", width, np.dtype(np.int64))
    if state is None or not width:
        return None
    values, vectors = symmetric_eigen(state.outer / state.n)
    trace = float(np.trace(state.outer)) / state.n
    rank = min(components, int((values > max(1, width) * np.finfo(float).eps * max(values[0], 0)).sum())) if values[0] > 0 else 0
    return Whitening(state.n, state.sums, vectors[:, :rank], values[:rank], values[:rank] / trace if trace else values[:rank])


def identity_error(points: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened points - identity|."""
    rank = len(model.eigenvalues)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in model.whitened(x)], pa.binary())], ["w"])

    state = _welford(points.select("x").mapInArrow(run, "w binary"), "w", rank, np.dtype(np.float64))
    return float(np.abs(state.outer / state.n - np.eye(rank)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component int, n, deviation, whitened double, explained double, identity_error double): one row for each vector and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    Vectors shorter than the longest are read as if filled up by zeros.
    Repeated rows, and rows with a null id, are each returned; a vector counts
    once in the fit however often it occurs. Directions without variance (one
    distinct vector, or fewer than ``components`` dimensions that vary) cannot
    be scaled to one and have no rows; of equal eigenvalues any orthogonal
    vectors are components. An empty table gives no rows. Entries beyond 2^53 /
    64, or deviations beyond 64 bits, raise. Further columns are not read.
    """
    spark = vectors.sparkSession
    workers_see_package(spark)
    rows, width = integer_vectors(vectors, id_col, vector_col)
    points = materialise(rows.select("x").distinct())
    model = fit_whitening(points, width, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    error, names, rank = identity_error(points, width, model), [f.split()[0] for f in schema.split(", ")], len(model.eigenvalues)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = np.frombuffer(b"".join(part["x"].to_pylist()), np.int64).reshape(-1, width)
                at = np.repeat(np.arange(len(x)), rank)
                again = lambda v: np.tile(v, len(x))
                columns = [part["vec_id"].take(pa.array(at)), again(np.arange(1, rank + 1, dtype=np.int32)), np.full(len(at), model.n, np.int64), model.deviation(x)[at], model.whitened(x).ravel(), again(model.explained), np.full(len(at), error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, schema)
