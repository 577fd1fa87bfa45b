"""Whitening of embeddings along their leading principal components.

Method. Entries c become whole numbers x = floor(256 * c). The fit list is every distinct x vector once; from it come, in two distributed
passes, the sums of each dimension (exact) and the covariance, centred before multiplying: every task adds up the products of its own
rows, and the partial matrices are summed row by row. The covariance alone, dimension by dimension, reaches the
driver. There Householder reflections make it tridiagonal, counts of sign changes (Sturm sequences) and bisection
find the leading eigenvalues, and inverse iteration their vectors, orthogonalised again within clusters of close eigenvalues. Means and components are broadcast,
and every row is projected where it lies.

Scale. Vectors travel once, for the distinct ones, as whole numbers of the least width that holds a row (two bytes an entry for entries
within 128), combined on the map side, so a vector that a third of all rows share is one row per task. A task holds one batch of rows and
one matrix; the driver holds matrices of dimension by dimension.

Rows. A null vector, an empty one, one with null or non-finite entries, and one with an entry whose x is no 64-bit number are dropped. Vectors of another
length than the most common one (of several, the longest) can't be compared and are dropped too. Repeated rows and rows without ``vec_id`` stay. Components without
variance are left out, so equal vectors, a single one and an empty table give no rows. ``deviation`` is null where it is no 64-bit number. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.batches import map_arrow
from feedlake.session import materialise

SCALE = 256
COMPONENTS = 4
#: Rows multiplied in one step.
STEP_ROWS = 4096
#: Partial matrices are summed in so many groups per row of the matrix before the last sum.
SLOTS = 32

_EPS = float(np.finfo(np.float64).eps)
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


# --- whole-number vectors ----------------------------------------------------------


def _packed(values: np.ndarray) -> list[bytes]:
    """Each row as the bytes of its entries, in the least width that holds them all, and that width; equal rows give equal bytes."""
    least = np.zeros(len(values), np.int8)
    for k, kind in enumerate(_WIDTHS[:-1]):
        info = np.iinfo(kind)
        least[((values < info.min) | (values > info.max)).any(axis=1)] = k + 1
    out: list[bytes] = [b""] * len(values)
    for k in np.unique(least).tolist():
        rows = np.flatnonzero(least == k)
        data, size = values[rows].astype(_WIDTHS[k]).tobytes(), int(_WIDTHS[k][-1]) * values.shape[1]
        for i, row in enumerate(rows.tolist()):
            out[row] = bytes([k]) + data[i * size : (i + 1) * size]
    return out


def _unpacked(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of ``_packed``, as a matrix."""
    rows = column.to_pylist()
    out = np.empty((len(rows), dimension), np.int64)
    for i, row in enumerate(rows):
        out[i] = np.frombuffer(row, _WIDTHS[row[0]], offset=1)
    return out


def coded(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, dimension, x`` of all rows that have whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lists = batch.column("v")
            size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()  # passes over null lists
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(flat.fill_null(0.0).to_numpy(zero_copy_only=False) * SCALE)
            bad = bad | ~(np.abs(x) < 2.0**63)  # also what is not finite
            x = np.where(bad, 0.0, x).astype(np.int64)
            ends = np.cumsum(size)
            wrong = np.append(0, np.cumsum(bad))
            able = (size > 0) & (wrong[ends] == wrong[ends - size])
            ids = batch.column("vec_id")
            for d in np.unique(size[able]).tolist():
                rows = np.flatnonzero(able & (size == d))
                matrix = x[(ends[rows] - d)[:, None] + np.arange(d)]
                yield {"vec_id": ids.take(pa.array(rows)), "dimension": np.full(len(rows), d), "x": _packed(matrix)}

    named = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return map_arrow(named, run, "vec_id bigint, dimension int, x binary")


# --- distributed sums --------------------------------------------------------------


def sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, low, high = 0, np.zeros(dimension, np.int64), np.zeros(dimension, object)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_ROWS):
                x = _unpacked(batch.column("x").slice(start, STEP_ROWS), dimension)
                n += len(x)
                # halves of 32 bits: no sum of a step leaves 64 bits
                low, high = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0)
        if n:
            total = [int(h) * (1 << 32) + int(a) for h, a in zip(high, low, strict=True)]
            yield {"pos": np.arange(dimension + 1), "total": [str(t) for t in [*total, n]]}

    partial = map_arrow(fit.select("x"), run, "pos int, total string")
    rows = partial.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one for each dimension
    found = {r["pos"]: int(r["total"]) for r in rows}
    return found.get(dimension, 0), [found.get(i, 0) for i in range(dimension)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, from the exact n * x - S wherever that fits 64 bits."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, total), default=0) < 1 << 62:
        return (n * x - np.asarray(total, np.int64)) / n
    return np.asarray([[(n * int(c) - s) / n for c, s in zip(row, total, strict=True)] for row in x], np.float64).reshape(x.shape)


def covariance(fit: DataFrame, dimension: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance of the fit list, divisor ``n``."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        matrix, some = np.zeros((dimension, dimension)), False
        for batch in batches:
            some = some or batch.num_rows > 0
            for start in range(0, batch.num_rows, STEP_ROWS):
                c = centred(_unpacked(batch.column("x").slice(start, STEP_ROWS), dimension), n, total)
                matrix += c.T @ c
        if some:
            yield {"pos": np.arange(dimension), "products": list(matrix)}

    def added(rows: pa.Table) -> pa.Table:
        flat = rows["products"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dimension)
        order = np.lexsort(flat.T[::-1])  # the same sum in whatever order the partial rows arrive
        return pa.table({"pos": rows["pos"][:1].cast(pa.int32()), "products": pa.array([flat[order].sum(axis=0)], pa.list_(pa.float64()))})

    schema = "pos int, products array<double>"
    partial = map_arrow(fit.select("x"), products, schema).withColumn("slot", F.spark_partition_id() % SLOTS)
    some = partial.groupBy("pos", "slot").applyInArrow(added, schema)
    out = np.zeros((dimension, dimension))
    for r in some.groupBy("pos").applyInArrow(added, schema).collect():  # one for each dimension
        out[r["pos"]] = r["products"]
    return (out + out.T) / (2 * n)


# --- leading eigenvectors ----------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal, and the unit vectors of the Householder reflections that lead there."""
    a = matrix.astype(np.float64, copy=True)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v[1:]).max(initial=0.0)
        if scale == 0.0:
            reflections.append(np.zeros(d - k - 1))
            continue
        v /= max(scale, abs(v[0]))
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        p -= (p @ v) * v
        part -= 2 * (np.outer(p, v) + np.outer(v, p))
        column = a[k + 1 :, k]
        column -= 2 * (v @ column) * v
        a[k, k + 1 :] = column
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def _over(diagonal: np.ndarray, squares: np.ndarray, at: float, floor: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are above ``at``: the positive terms of its Sturm sequence."""
    count, q = 0, 1.0
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (squares[k - 1] / q if k else 0.0)
        if abs(q) < floor:
            q = -floor
        count += q > 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, wanted: int) -> list[float]:
    """The largest eigenvalues, falling, each halved in to the last digits."""
    around = np.abs(np.append(beside, 0.0)) + np.abs(np.append(0.0, beside))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    size = max(abs(low), abs(high))
    floor = max(size * _EPS * _EPS, 1e-300)
    squares = beside**2
    out = []
    for k in range(min(wanted, len(diagonal))):
        a, b = low - 2 * _EPS * size, (out[-1] if out else high) + 2 * _EPS * size
        while b - a > 2 * _EPS * max(abs(a), abs(b)):
            middle = a + (b - a) / 2
            if middle in (a, b):
                break
            if _over(diagonal, squares, middle, floor) > k:
                a = middle
            else:
                b = middle
        out.append(a + (b - a) / 2)
    return out


def _solved(diagonal: np.ndarray, beside: np.ndarray, at: float, b: np.ndarray, floor: float) -> np.ndarray:
    """(T - at) x = b by elimination with exchanged rows; a pivot of zero becomes ``floor``."""
    n = len(diagonal)
    u0, u1, u2 = diagonal - at, np.append(beside, 0.0), np.zeros(n)
    b = b.copy()
    for k in range(n - 1):
        below, right = beside[k], u0[k + 1]
        after = u1[k + 1]
        if abs(below) > abs(u0[k]):
            factor = u0[k] / below
            u0[k], right, u1[k], u2[k], after = below, u1[k] - factor * right, right, after, -factor * after
            b[k], b[k + 1] = b[k + 1], b[k] - factor * b[k + 1]
        else:
            u0[k] = u0[k] if abs(u0[k]) > floor else floor
            factor = below / u0[k]
            right -= factor * u1[k]
            b[k + 1] -= factor * b[k]
        u0[k + 1], u1[k + 1] = right, after
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        rest = b[k] - (u1[k] * x[k + 1] if k + 1 < n else 0.0) - (u2[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = rest / (u0[k] if abs(u0[k]) > floor else floor)
    return x


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; none that are zero to double precision.

    The first entry of largest size of a vector is positive.
    """
    d = len(matrix)
    size = float(np.abs(matrix).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((d, 0))
    # by a power of two, so that nothing is rounded
    unit = 2.0 ** math.floor(math.log2(size))
    matrix = matrix / unit
    diagonal, beside, reflections = tridiagonal(matrix)
    values = [e for e in leading_values(diagonal, beside, wanted) if e > d * _EPS * float(np.trace(matrix))]
    norm = float(np.abs(matrix).sum(axis=1).max())
    floor = _EPS * norm
    vectors: list[np.ndarray] = []
    start, first = np.random.default_rng(d), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k  # a cluster of its own
        # members of a cluster are pushed apart, or their systems would be one and the same
        at = value - (k - first) * 4 * _EPS * norm
        x = start.standard_normal(d)
        for _ in range(6):
            x = _solved(diagonal, beside, at, x / np.linalg.norm(x), floor)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in vectors[first:k]:
                    x -= (x @ other) * other
            x /= np.linalg.norm(x)
        vectors.append(x)
    basis = np.asarray(vectors).reshape(-1, d).T.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        basis[k + 1 :] -= 2 * np.outer(v, v @ basis[k + 1 :])
    basis /= np.linalg.norm(basis, axis=0)
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(values))]) if len(values) else 1.0
    return np.asarray(values) * unit, basis * signs


# --- the operator ------------------------------------------------------------------


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row with whole numbers and each component.

    ``identity_error`` is measured on the whitened fit list: the largest entry of its covariance minus the identity.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = materialise(coded(vectors, column), "whitening-rows")
    sizes = rows.groupBy("dimension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dimension")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension = sizes["dimension"]
    rows = rows.where(F.col("dimension") == dimension)
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    n, total = sums(fit, dimension)
    matrix = covariance(fit, dimension, n, total)
    values, basis = leading(matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    projection = basis / np.sqrt(values)
    explained = values / np.trace(matrix)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {f"w{k}": c for k, c in enumerate((centred(_unpacked(batch.column("x"), dimension), n, total) @ projection).T)}

    held = map_arrow(fit, projected, ", ".join(f"w{k} double" for k in range(len(values))))
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    spread = held.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, spread, strict=True))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = _unpacked(batch.column("x"), dimension)
            part = centred(x, n, total) @ projection
            k = part.shape[1]
            yield {
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))), "component": np.tile(np.arange(1, k + 1), len(x)), "n": np.full(len(x) * k, n),
                "deviation": [d for d in _deviations(x, n, total) for _ in range(k)], "whitened": part.reshape(-1), "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * k, error),
            }

    return map_arrow(rows.select("vec_id", "x"), results, schema)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - S) squared, exact; None beyond 64 bits."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, total))
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - np.asarray(total, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]
