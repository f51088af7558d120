"""Whitening of embeddings by contour integration.

1. Sums of every dimension, then the covariance, are gathered in Spark: each task sends one row for a slot. Entries are whole numbers, shifted by the whole number
   next to the mean before they are multiplied, so that the products and their sums are exact; what the mean is off by is taken off afterwards.
2. On the driver, which holds one matrix of dimension x dimension (at most MAX_DIMENSION): inertia counts (signs of the pivots of the shifted tridiagonal
   form) cut the upper spectrum into intervals of few eigenvalues with edges away from all of them. For each interval, complex shifted solves at the nodes
   of a quadrature on the circle around it project random vectors onto its eigenvectors; Rayleigh-Ritz on the projection gives the eigenpairs; this
   repeats until the residuals are at rounding level. The pairs found in an interval must be as many as the counts at its edges say.
3. Components are numbered by falling eigenvalue. Their covariance over the whitened list is gathered in Spark, as a check, and every row is projected.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do those whose whole-number entries would not fit 62 bits, nor those of another
length than most vectors have (of equally frequent lengths the smallest counts). Eigenvalues of at most RANK times the largest are of no direction that the
list spans; they give no component, so a list of equal vectors gives no rows, as an empty table does. A deviation over 64 bits is null. Rows that repeat each
count; a null id is an id like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.words import small_batches

MAX_DIMENSION = 4096
#: Nodes of the quadrature on the upper half circle, eigenvalues of an interval, rounds of projection.
NODES, PER_INTERVAL, ROUNDS = 8, 8, 30
#: Least share of the largest eigenvalue that a component has.
RANK = 1e-10
SCALE, SHIFT = 64, 1_000_000


# ------------------------------------------------------------------ eigenpairs
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1:] -= 2 * np.outer(x, x @ a[k + 1:])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Counts of the eigenvalues below a shift."""

    def __init__(self, a: np.ndarray) -> None:
        self.diagonal, off = tridiagonal(a)
        self.squares = np.r_[0.0, off * off]
        self.tiny = np.finfo(float).tiny + np.finfo(float).eps ** 2 * max(1e-300, float(np.abs(self.diagonal).max(initial=0)))

    def below(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for d, s in zip(self.diagonal.tolist(), self.squares.tolist(), strict=True):
            pivot = d - shift - s / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot < 0
        return count


def _edge(count: Inertia, shift: float, room: float, clear: float) -> float | None:
    """A place near the shift with no eigenvalue within `clear`; None if there is none to be found."""
    for step in (0, 1, -1, 2, -2, 3, -3, 4, -4):
        at = shift + step * room / 10
        if count.below(at - clear) == count.below(at + clear):
            return at
    return None


def _intervals(count: Inertia, low: float, high: float, most: int, clear: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues) from the top down that hold the largest `most` eigenvalues above low."""
    out: list[tuple[float, float, int]] = []
    todo, have = [(low, high, count.below(low), count.below(high))], 0
    while todo and have < most:
        a, b, under, over = todo.pop()
        if under == over:
            continue
        if over - under > PER_INTERVAL and b - a > 64 * clear:
            mid = _edge(count, (a + b) / 2, (b - a) / 2, clear)
            if mid is not None:
                at = count.below(mid)
                todo += [(a, mid, under, at), (mid, b, at, over)]
                continue
        out.append((a, b, over - under))
        have += over - under
    return out


def contour(a: np.ndarray, low: float, high: float, expected: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs in an interval, which must be as many as expected."""
    n = len(a)
    y = np.random.default_rng(n).standard_normal((n, min(n, expected + max(8, expected // 2))))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(0.5j * np.pi * (nodes + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    last, stale = np.inf, 0
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for turn, weight in zip(turns, weights, strict=True):
            q += weight / 2 * (radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(n) - a, y.astype(complex))).real
        left, size, _ = np.linalg.svd(q, full_matrices=False)
        q = left[:, size > size[0] * 1e-14]
        values, mix = np.linalg.eigh(q.T @ (a @ q))
        x = q @ mix
        residuals = np.where((values > low) & (values < high), np.abs(a @ x - x * values).max(0), np.inf)
        best = np.sort(np.argsort(residuals, kind="stable")[:expected])  # a mixture from both sides of the interval may have its value inside
        residual = residuals[best].max() if len(best) == expected else np.inf
        stale = stale + 1 if residual >= last / 2 else 0
        last = min(last, residual)
        if residual <= 4e-15 * scale or residual <= 1e-12 * scale and stale >= 2:
            break
        y = x if x.shape[1] == y.shape[1] else np.c_[x, np.random.default_rng(n + 1).standard_normal((n, y.shape[1] - x.shape[1]))]
    found = int((residuals <= 1e-11 * scale).sum())
    if found != expected:
        raise ArithmeticError(f"{expected} eigenvalues counted from {low} to {high}, {found} found")
    return values[best], x[:, best]


def principal(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns; those of at most RANK times the largest are left out."""
    n = len(a)
    top = float(np.abs(a).sum(1).max(initial=0)) if n else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((n, 0))
    count, clear = Inertia(a), 1e-13 * top
    high, low = top * 1.01, 0.0
    for _ in range(60):  # the largest eigenvalue, well enough for the bound of rank
        mid = (low + high) / 2
        low, high = (mid, high) if count.below(mid) < n else (low, mid)
    floor = _edge(count, RANK * high, RANK * high, min(clear, RANK * high / 100))
    floor = RANK * high if floor is None else floor
    found = [contour(a, *part, top) for part in _intervals(count, floor, top * 1.01, most, clear)]
    if not found:
        return np.zeros(0), np.zeros((n, 0))
    q = np.linalg.qr(np.concatenate([x for _, x in found], 1))[0]  # one more Rayleigh-Ritz over all of them
    values, mix = np.linalg.eigh(q.T @ (a @ q))
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], q @ mix[:, order]


# ------------------------------------------------------------------------ rows
def _whole(batch: pa.RecordBatch, length: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and whole-number entries of the usable vectors, by their length."""
    column = batch.column("vector")
    out: dict[int, tuple[list, list]] = {}
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    at = column.offsets.to_numpy()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    for size in np.unique(sizes):
        if size == 0 or length is not None and size != length:
            continue
        rows = np.flatnonzero(sizes == size)
        x = values[at[rows][:, None] + np.arange(size)] * SCALE
        fits = (np.abs(x) < 2.0 ** 62).all(1)  # no for nan and infinity
        if fits.any():
            out[int(size)] = rows[fits], np.floor(x[fits]).astype(np.int64) + SHIFT
    return out


def _summed(vectors: DataFrame, length: int, slots: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all usable vectors of `slots` numbers; one row a task and slot goes into the shuffle, one a slot to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots)
        for batch in batches:
            for _, x in _whole(batch, length).values():
                total += add(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["slot", "value"])

    out = np.zeros(slots)
    for slot, value in vectors.mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value")).collect():
        out[slot] = value
    return out


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length, and the exact sum of each of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for length, (rows, x) in _whole(batch).items():
                n[length] = n.get(length, 0) + len(rows)
                small = float(np.abs(x.astype(float)).max()) * len(x) < 2.0 ** 62
                more = x.sum(0).tolist() if small else x.astype(object).sum(0).tolist()
                total[length] = [a + b for a, b in zip(total.get(length, [0] * length), more, strict=True)]
        rows = [(length, k, n[length], str(s)) for length, sums in total.items() for k, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*rows, strict=True)) or [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["length", "slot", "n", "total"])

    sums = vectors.mapInArrow(run, "length int, slot int, n long, total string").groupBy("length", "slot").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rows = sums.orderBy(F.desc("n"), "length", "slot").limit(MAX_DIMENSION).collect()
    if not rows:
        return 0, []
    if rows[0]["length"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {rows[0]['length']} entries; at most {MAX_DIMENSION} are taken")
    return rows[0]["n"], [int(r["total"]) for r in rows if r["length"] == rows[0]["length"]]


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """For each usable vector and component: key, component, n, deviation (squared distance from the mean, times n * n), whitened (the projection over the root
    of the eigenvalue), explained (share of the variance) and identity_error (largest difference of the whitened list's covariance from the identity)."""
    small_batches(rows.sparkSession, 2000)
    rows = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    vectors = rows.select("vector")
    kind = rows.schema["key"].dataType.simpleString()
    n, sums = _sums(vectors)
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = np.array([(s - n * c) / n for s, c in zip(sums, centre.tolist(), strict=True)])  # the mean is centre + off
    up = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(float)
        return (y.T @ y)[up]

    cov = np.zeros((d, d))
    if n:
        cov[up] = _summed(vectors, d, len(up[0]), products) / n
        cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(off, off)
    values, components = principal(cov, most)
    k, trace = len(values), float(np.trace(cov))
    project = components / np.sqrt(values)
    error = 0.0

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre).astype(float) - off) @ project

    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            z = projected(x)
            return np.r_[z.sum(0), (z.T @ z).ravel()]

        total = _summed(vectors, d, k + k * k, moments) / n
        error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * float(np.abs((x - centre).astype(float)).max(initial=0) + 1)
        if largest < 2.0 ** 62 and d * largest * largest < 2.0 ** 62:
            t = n * (x - centre) - np.array([s - n * c for s, c in zip(sums, centre.tolist(), strict=True)], np.int64)
            return (t * t).sum(1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _whole(batch, d).values() if k else ():
                size = len(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, n)), pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(projected(x).ravel()), pa.array(np.tile(values / trace, size)), pa.array(np.full(size * k, error))],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"key {kind}, {_OUT}").withColumnRenamed("key", key)
