"""Whitening directions of vectors, by a bidiagonal qd solver on a triangular factor.

Vectors become integers, so that sums are exact. The distinct ones are centred and reduced block after block to a triangular R by QR, in
every task by itself and then eight factors at a time, up to one. R is d x d, whatever the number of rows. One task makes it bidiagonal by
Householder reflections, finds the squares of all singular values by dqds, and the right singular vectors of the largest by
twisted factorisations. These are the eigenvectors of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.store import Shared, save

#: A component c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows reduced at a time, and factors combined by one task.
BLOCK_ROWS, FAN = 2048, 8
_EPS = np.finfo(float).eps
_LONG = 2**63 - 1


# --- linear algebra on one d x d factor --------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): R = U B V' with B upper bidiagonal, a its diagonal, b the one above; U is not formed."""
    r = r.copy()
    n = len(r)
    v = np.eye(n)
    for k in range(n):
        h, beta = _reflector(r[k:, k])
        r[k:, k:] -= beta * np.outer(h, h @ r[k:, k:])
        if k < n - 2:
            h, beta = _reflector(r[k, k + 1 :])
            r[k:, k + 1 :] -= beta * np.outer(r[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(h, beta): x - beta h (h'x) has zeros below its first entry."""
    size = np.abs(x).max()
    if size == 0:
        return np.zeros_like(x), 0.0
    h = x / size
    h[0] += np.copysign(np.linalg.norm(h), h[0])
    return h, 2.0 / (h @ h)


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd transform with a shift: new q and e, and the values d on the way."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        ds.append(d)
        pivot = d + e[k]
        if pivot == 0:  # the block ends here
            es.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / pivot
            es.append(e[k] * t)
            d = d * t - shift
        qs.append(pivot)
    return [*qs, d], es, [*ds, d]


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal, largest first, by dqds.

    A step without a shift yields d with 1 / (1/d_1 + ... + 1/d_n) at most the least square; that is the next shift, so no
    step can fail. A block is cut where an entry beside the diagonal no longer counts.
    """
    scale = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if scale == 0:
        return np.zeros(len(a))
    blocks, out = [(list((a / scale) ** 2), list((b / scale) ** 2), 0.0)], []
    while blocks:
        q, e, total = blocks.pop()
        if len(q) == 1:
            out.append(max(q[0] + total, 0.0))
            continue
        cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _EPS**2 * max(total + min(q[k], q[k + 1]), 1e-300)), None)
        if cut is not None:
            blocks += [(q[: cut + 1], e[:cut], total), (q[cut + 1 :], e[cut + 1 :], total)]
            continue
        if q[0] < q[-1]:  # the least belongs at the end
            q, e = q[::-1], e[::-1]
        q, e, d = _qd_step(q, e, 0.0)
        if min(d) > 0:
            shift = (1 - 1e-12) / sum(1 / x for x in d)
            shifted = _qd_step(q, e, shift)
            if min(shifted[2]) >= 0:
                q, e, total = shifted[0], shifted[1], total + shift
        blocks.append((q, e, total))
    return np.sort(np.array(out))[::-1] * scale**2


def _twisted(diagonal: np.ndarray, lower: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L' for ``value``: factored from both ends, twisted where the two leave the least."""
    n, tiny = len(diagonal), 1e-300
    s, p = np.empty(n), np.empty(n)
    down, up = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + diagonal[i] or tiny
        down[i] = diagonal[i] * lower[i] / pivot
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[n - 1] = diagonal[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = diagonal[i] * lower[i] ** 2 + p[i + 1] or tiny
        t = diagonal[i] / pivot
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_singular_vectors(a: np.ndarray, b: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal for the given squares (largest first), as columns.

    Vectors of squares that nearly agree are turned against each other by inverse iteration.
    """
    n, scale = len(a), max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) or 1.0
    a, b, squares = a / scale, b / scale, squares / scale**2
    a = np.where(np.abs(a) < _EPS * 1e-3, _EPS * 1e-3, a)
    full = np.diag(a) + np.diag(b, 1)
    full = full.T @ full
    out = np.zeros((n, len(squares)))
    rng = np.random.default_rng(5)
    for k, value in enumerate(squares):
        with np.errstate(all="ignore"):
            z = _twisted(a**2, b / a[:-1], value)
        close = [j for j in range(k) if squares[j] - value <= 1e-3 * squares[0]]
        residual = np.linalg.norm(full @ z - value * z) if np.isfinite(z).all() else np.inf
        others = out[:, close]
        if residual > 1e-13 or (close and np.abs(others.T @ z).max() > 1e-13):
            z = z if np.isfinite(z).all() else rng.standard_normal(n)
            shifted = full - (value + 4 * _EPS) * np.eye(n)
            for _ in range(4):
                z = z - others @ (others.T @ z)
                if np.linalg.norm(z) < 1e-8:
                    z = rng.standard_normal(n)
                    z = z - others @ (others.T @ z)
                z = np.linalg.solve(shifted, z / np.linalg.norm(z))
                z = z / np.linalg.norm(z)
            z = z - others @ (others.T @ z)
            z = z - others @ (others.T @ z)
            z = z / np.linalg.norm(z)
        out[:, k] = z
    return out


def solve(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, directions as columns, shares of the trace) of R'R / n, largest first."""
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: len(r)] = r[:d]
    a, b, v = bidiagonal(square)
    squares = squared_singular_values(a, b)
    top = squares[:components]
    values, trace = top / n, squares.sum() / n
    return values, v @ right_singular_vectors(a, b, top), values / trace if trace > 0 else np.full(len(top), np.nan)


# --- passes over the vectors --------------------------------------------------


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with column x: floor(64 c) + 1000000 of each component, as array<long>. Vectors that are null or hold a null or non-finite component
    go, empty ones too. Components beyond 2^53 are taken as 2^53."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    bound = float(2**53)
    number = lambda v: F.greatest(F.least(v.cast("double"), F.lit(bound)), F.lit(-bound)) * SCALE
    x = F.transform(c, lambda v: F.floor(number(v)).cast("long") + OFFSET)
    return vectors.filter(F.coalesce(finite & (F.size(c) > 0), F.lit(False))).withColumn("x", x)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of x) for each length of vector in a batch."""
    column = batch.column("x")
    sizes = np.diff(np.asarray(column.offsets))
    values = column.values.to_numpy(zero_copy_only=False)
    starts = np.asarray(column.offsets)[:-1]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for low in range(0, len(rows), BLOCK_ROWS):
            some = rows[low : low + BLOCK_ROWS]
            yield some, values[starts[some][:, None] + np.arange(size)]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if max(int(x.max()), -int(x.min())) * n < 2**61 and max(map(abs, sums)) < 2**61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, x in _blocks(batch):
            exact = x if max(int(x.max()), -int(x.min())) < 2**50 else x.astype(object)
            n, sums = total.get(x.shape[1], (0, 0))
            total[x.shape[1]] = n + len(rows), sums + exact.sum(axis=0).astype(object)
    for dim, (n, sums) in total.items():
        columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums), pa.decimal128(38, 0))], ["dim", "at", "n", "s"])


def _factors(stats: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, found = stats.value, {}
        for batch in batches:
            for _, x in _blocks(batch):
                n, sums = known[x.shape[1]]
                rows = _centred(x, n, sums).astype(float) / n
                found[x.shape[1]] = np.linalg.qr(np.vstack([found[x.shape[1]], rows]) if x.shape[1] in found else rows, mode="r")
        part = TaskContext.get().partitionId()
        for dim, r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([r.tobytes()])], ["dim", "part", "r"])

    return run


def _combine(key: tuple, factors: pa.Table) -> pa.Table:
    dim, part = (k.as_py() for k in key)
    r = np.zeros((0, dim))
    for raw in factors.sort_by("part").column("r"):
        r = np.linalg.qr(np.vstack([r, np.frombuffer(raw.as_py()).reshape(-1, dim)]), mode="r")
    return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()), "r": [r.tobytes()]})


def _solver(stats: Shared, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stats.value
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("r").to_pylist()):
                values, directions, explained = solve(np.frombuffer(raw).reshape(-1, dim), known[dim][0], components)
                kept = [pa.array([dim], pa.int32())] + [pa.array([m.tobytes()]) for m in (values, np.ascontiguousarray(directions.T), explained)]
                yield pa.RecordBatch.from_arrays(kept, ["dim", "values", "directions", "explained"])

    return run


class Model:
    """For each length of vector: n and sums of the fit list, eigenvalues, directions as rows, shares of the trace, identity error."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, directions: np.ndarray, explained: np.ndarray, error: float | None = None):
        self.n, self.sums, self.values, self.directions, self.explained, self.error = n, sums, values, directions, explained, error
        # below this a variance is rounding
        self.positive = values > values[0] * (len(sums) * 4 * _EPS) ** 2

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S, whitened components); components without variance are NaN."""
        deviation = _centred(x, self.n, self.sums)
        scaled = np.divide(1.0, np.sqrt(self.values), where=self.positive, out=np.full(len(self.values), np.nan))
        return deviation, (deviation.astype(float) / self.n) @ self.directions.T * scaled


def _moments(models: Shared):
    """Sums of the whitened components and of their products over the rows of a task, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        known, found = models.value, {}
        for batch in batches:
            for _, x in _blocks(batch):
                _, white = known[x.shape[1]].whitened(x)
                one = np.concatenate([white.sum(axis=0)[None], white.T @ white])
                found[x.shape[1]] = found.get(x.shape[1], 0) + one
        for dim, m in found.items():
            columns = [pa.array([dim] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "at", "m"])

    return run


def fit(rows: DataFrame, components: int = 16) -> dict[int, Model]:
    """A model for each length of vector in ``rows`` (x), over the distinct vectors. What comes to the driver grows with the
    lengths of vectors only."""
    spark = rows.sparkSession
    distinct = save(rows.select("x").distinct())
    totals = distinct.mapInArrow(_sums, "dim int, at int, n long, s decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    counted: dict[int, tuple[int, np.ndarray]] = {}
    for dim, at, n, s in totals.orderBy("dim", "at").collect():
        counted.setdefault(dim, (n, np.zeros(dim, object)))[1][at] = int(s)
    if not counted:
        return {}
    stats = Shared(spark, counted)
    factors = save(distinct.mapInArrow(_factors(stats), "dim int, part int, r binary"))
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        grouped = factors.withColumn("to", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "to")
        factors = save(grouped.applyInArrow(_combine, "dim int, part int, r binary"))
        parts = -(-parts // FAN)
    models = {}
    for dim, values, directions, explained in factors.mapInArrow(_solver(stats, components), "dim int, values binary, directions binary, explained binary").collect():
        n, sums = counted[dim]
        models[dim] = Model(n, sums, np.frombuffer(values), np.frombuffer(directions).reshape(-1, dim), np.frombuffer(explained))
    moments = distinct.mapInArrow(_moments(Shared(spark, models)), "dim int, at int, m double").groupBy("dim", "at").agg(F.sum("m").alias("m"))
    entries: dict[int, dict[int, float]] = {}
    for dim, at, m in moments.collect():
        entries.setdefault(dim, {})[at] = m
    for dim, model in models.items():
        k = len(model.values)
        table = np.array([entries[dim][i] for i in range(k * (k + 1))]).reshape(k + 1, k) / model.n
        off = np.abs(table[1:] - np.outer(table[0], table[0]) - np.eye(k))[np.ix_(model.positive, model.positive)]
        model.error = float(off.max()) if off.size else None
    return models


def _whiten(models: Shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in batches:
            for rows, x in _blocks(batch):
                model = known[x.shape[1]]
                deviation, white = model.whitened(x)
                squares = [int(s) for s in (deviation.astype(object) ** 2).sum(axis=1)]
                k = len(model.values)
                repeat = np.repeat(rows, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).take(pa.array(repeat)) for c in keep],
                        pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                        pa.array([model.n] * len(repeat), pa.int64()),
                        pa.array([s if s <= _LONG else None for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained, len(rows)), from_pandas=True),
                        pa.array([model.error] * len(repeat), pa.float64()),
                    ],
                    [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 16, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The ``keep`` columns with component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty, or hold a null or non-finite component give no rows; repeated rows stay, and count once in the fit. Vectors
    of different lengths are fitted apart. A component without variance has no whitened value (null) and takes no part in
    identity_error; without any variance explained and identity_error are null. A deviation beyond a long is null. An empty table gives no rows.
    """
    rows = integers(vectors, vector).select(*keep, "x")
    models = fit(rows, components)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    schema = f"{fields}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_whiten(Shared(vectors.sparkSession, models), list(keep)), schema)
