"""Whitening of embeddings with the principal components of their covariance, found by QDWH spectral divide-and-conquer.

Each entry c becomes the integer floor(1024 c) + 100000, so that counts, sums and products of entries are exact in any
order. Rows are read in four passes, each a scan with partial sums per partition: number and sums; products of what is
left after the integer part of the means is taken off; covariance of the whitened rows; and the rows themselves. Only
d x d numbers reach the driver, d being the length of a vector.

There the covariance is formed exactly from the integers and divided once. Its components come from spectral
divide-and-conquer: for a shift s the orthogonal polar factor U of V - s I, by dynamically weighted Halley iterations, gives
the projector (U + I) / 2 on the invariant subspace of the eigenvalues above s; a basis of it and of its complement splits
V into two smaller problems, until they are diagonal to rounding. Only subspaces that can hold a wanted component are
split further. Means, components and eigenvalues are broadcast (d x k numbers), and rows are projected where they lie.

Rows whose vector is NULL, or holds NULL, NaN, infinite or (with 1024 c beyond 2**40) not representable entries are dropped,
as are vectors that are shorter or longer than most (of equally frequent lengths the longest counts). Components are
those with an eigenvalue above rounding, so a table with one row, equal rows, empty vectors or no rows gives no rows.
Equal eigenvalues have any orthonormal basis. A row without vec_id stays, repeated rows stay and count, other columns,
whatever their names, are not looked at. `deviation` is NULL where it does not fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import ship, table

#: Steps of a fixed point number, what is added to it, wanted components, largest entry, rows of one matrix product.
STEPS, SHIFT, COMPONENTS, LARGEST, ROWS = 1024, 100000, 8, 2.0**40, 4096
EPS = np.finfo(float).eps


def halley_weights(low: float) -> tuple[float, float, float]:
    """The weights of one step if all singular values are in [low, 1]."""
    d = (4 * (1 - low**2) / low**4) ** (1 / 3)
    a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar_factor(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix that is not singular to working precision."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    r = np.linalg.qr(x, mode="r")
    # a lower bound of the smallest singular value, from the inverse of the triangular factor
    diagonal = np.abs(np.diag(r))
    low = 1 / np.linalg.norm(np.linalg.inv(r)) if diagonal.min() > EPS * diagonal.max() else EPS
    low = min(1.0, max(low, EPS))
    eye = np.eye(n)
    for _ in range(40):
        a, b, c = halley_weights(low) if 1 - low > EPS else (3.0, 1.0, 3.0)
        if c > 100:  # safe for small singular values
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            w = np.linalg.cholesky(eye + c * x.T @ x)
            new = b / c * x + (a - b / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        new = (new + new.T) / 2
        step, low = np.linalg.norm(new - x), min(1.0, low * (a + b * low**2) / (1 + c * low**2))
        x = new
        if step < n * 10 * EPS:
            break
    return x


def split(matrix: np.ndarray, rounding: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns span the eigenvectors above a shift, and k; None if nothing splits."""
    n = len(matrix)
    diagonal = np.sort(np.diag(matrix))
    size = np.linalg.norm(matrix)
    tries = [np.median(diagonal), np.trace(matrix) / n, *(diagonal[i : i + 2].mean() for i in np.argsort(
        -np.diff(diagonal)))]
    # a shift that is an eigenvalue to rounding gives no projector: others beside it are tried
    for shift in [t + size * e for t in tries for e in (0.0, 1e-9, -1e-6)]:
        try:
            u = polar_factor(matrix - shift * np.eye(n))
        except np.linalg.LinAlgError:
            continue
        projector = (u + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-8:
            continue
        # columns of the projector in the order of their norms, as pivots: the range first, then its complement
        order = np.argsort(-np.diag(projector))
        basis = np.linalg.qr(projector[:, order[:k]])[0]
        basis = np.linalg.qr(projector @ basis)[0]
        if np.linalg.norm(projector @ basis - basis) > 1e-8 or np.linalg.norm(basis.T @ basis - np.eye(k)) > 1e-8:
            basis = np.linalg.qr(projector @ np.random.default_rng(k).normal(size=(n, k)))[0]
            basis = np.linalg.qr(projector @ basis)[0]
        rest = np.linalg.qr(np.hstack([basis, np.eye(n)]))[0]
        q = np.hstack([basis, rest[:, k:n]])
        if np.linalg.norm(q[:, :k].T @ matrix @ q[:, k:]) <= 8 * rounding:
            return q, k
    return None


def components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and their eigenvectors (columns) of a symmetric matrix, `wanted` at most."""
    matrix = (matrix + matrix.T) / 2
    rounding = len(matrix) * EPS * np.linalg.norm(matrix)

    def largest(basis: np.ndarray, part: np.ndarray, most: int) -> list[np.ndarray]:
        found = split(part, rounding) if np.linalg.norm(part - np.diag(np.diag(part))) > rounding else None
        if found is None:
            return [basis[:, i] for i in np.argsort(-np.diag(part), kind="stable")[:most]]
        q, k = found
        sides = [(basis @ x, x.T @ part @ x) for x in (q[:, :k], q[:, k:])]
        upper = largest(*sides[0], most)
        # what the first part holds is above the shift, so the second one is needed only for what it lacks
        return upper + (largest(*sides[1], most - k) if k < most else [])

    found = largest(np.eye(len(matrix)), matrix, wanted) if len(matrix) else []
    values, vectors = refined(matrix, np.array(found).T.reshape(len(matrix), -1))
    if vectors.size and np.linalg.norm(matrix @ vectors - vectors * values) > 64 * rounding:
        raise ArithmeticError("no shift splits this covariance")
    return values, vectors


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal vectors with their Rayleigh quotients, falling."""
    if not vectors.size:
        return np.zeros(0), vectors
    q, r = np.linalg.qr(vectors)
    vectors = q * np.where(np.diag(r) < 0, -1, 1)
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening(NamedTuple):
    """n, exact sums, components (d x k), eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def finite_rows(column: pa.Array, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their entries as integers (rows x length)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(entries * STEPS)
        good = np.abs(scaled) <= LARGEST
    bad = np.concatenate([[0], np.cumsum(~good)])
    first, last = offsets[:-1], offsets[1:]
    counts = ~column.is_null().to_numpy(zero_copy_only=False) & (bad[last] == bad[first])
    if length is None:
        return counts, last - first
    counts &= last - first == length
    at = first[counts][:, None] + np.arange(length)
    return counts, scaled[at].astype(np.int64) + SHIFT


def products(x: np.ndarray) -> np.ndarray:
    """x.T @ x as exact Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * max(1, len(x)) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    high, low = x >> 20, x & ((1 << 20) - 1)
    h, v = (a.astype(np.float64) for a in (high, low))
    parts = [np.rint(p).astype(np.int64).astype(object) for p in (h.T @ h, h.T @ v, v.T @ v)]
    return (parts[0] << 40) + ((parts[1] + parts[1].T) << 20) + parts[2]


def blocks_of(vectors: pa.Array, length: int):
    """Entries of the rows that count, a bounded number of rows at a time."""
    most = max(1, min(ROWS, (1 << 21) // max(1, length)))
    for first in range(0, len(vectors), most):
        counts, x = finite_rows(vectors.slice(first, most), length)
        yield first, counts, x


def picked(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))


def most_frequent_length(rows: DataFrame) -> int:
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, n = finite_rows(batch.column(0), None)
            found, times = np.unique(n[counts], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times)], names=["length", "n"])

    found = rows.mapInArrow(lengths, "length long, n long").groupBy("length").agg(F.sum("n").alias("n"))
    best = found.orderBy(F.desc("n"), F.desc("length")).first()
    return best["length"] if best else 0


def fit(vectors: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS) -> Whitening | None:
    """Components of all vectors; None if there is no spread."""
    ship(vectors.sparkSession)
    rows = picked(vectors, vector)
    length = most_frequent_length(rows)
    if not length:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, object)
        for batch in batches:
            for _, _, x in blocks_of(batch.column(0), length):
                n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, length), pa.int32()), pa.array([n, *total], pa.decimal128(38))], names=["i", "s"])

    added = rows.mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    told = {r["i"]: int(r["s"]) for r in added}
    if not told:
        return None
    n, total = told[-1], [told[i] for i in range(length)]
    means = np.array([t // n for t in total], np.int64)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros((length, length), object)
        for batch in batches:
            for _, _, x in blocks_of(batch.column(0), length):
                if len(x):
                    summed = summed + products(x - means)
        for i in range(length):
            if summed[i].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(length - i, i), pa.int32()), pa.array(np.arange(i, length), pa.int32()),
                     pa.array(list(summed[i, i:]), pa.decimal128(38))], names=["i", "j", "s"])

    pairs = rows.mapInArrow(gram, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    left = [t - n * int(m) for t, m in zip(total, means)]  # sums of what is left, below n
    covariance = np.zeros((length, length))
    for i in range(length):
        covariance[i, i:] = covariance[i:, i] = [-(left[i] * left[j]) / (n * n) for j in range(i, length)]
    for r in pairs.toLocalIterator():
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * int(r["s"]) - left[i] * left[j]) / (n * n)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    values, found = components(covariance, min(wanted, length))
    some = values > length * EPS * values[0]
    return Whitening(n, total, found[:, some], values[some], trace)


def whitened_rows(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - S / n) projected on the components, over the roots of their eigenvalues."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([s % model.n / model.n for s in model.sums])
    return ((x - whole) - part) @ model.vectors / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n x - S)**2 over the dimensions, exactly; None beyond 64 bits."""
    n, length = model.n, x.shape[1]
    if not len(x):
        return []
    high, low = x.max(0), x.min(0)
    most = max(max(abs(n * int(high[d]) - s), abs(n * int(low[d]) - s)) for d, s in enumerate(model.sums))
    if most**2 * length < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
        return [int(v) for v in ((x * n - np.array(model.sums, np.int64)) ** 2).sum(1)]
    exact = ((x.astype(object) * n - np.array(model.sums, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k, length = len(model.values), len(model.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, _, x in blocks_of(batch.column(0), length):
                w = whitened_rows(x, model)
                first, second = first + w.sum(0), second + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))],
            names=["i", "s"])

    rows = picked(vectors, vector)
    told = rows.mapInArrow(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = np.array([r["s"] for r in sorted(told, key=lambda r: r["i"])]) / model.n
    # whitened rows are centred: their mean is rounding only, and taken off
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """`key`, `component` (from 1), `n`, `deviation`, `whitened`, `explained`, `identity_error`: one row for each row that
    counts and each component."""
    model = fit(vectors, vector, wanted)
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    shape = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        out = vectors.sparkSession.createDataFrame([], shape)
        return out.withColumnRenamed("key", key)
    error, k, length = identity_error(vectors, model, vector), len(model.values), len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, x in blocks_of(batch.column(1), length):
                m = len(x)
                keys = batch.column(0).slice(first, len(counts)).filter(pa.array(counts))
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n)), pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                    pa.array(whitened_rows(x, model).ravel()), pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, shape).withColumnRenamed("key", key)


def op11_whitening(spark, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
