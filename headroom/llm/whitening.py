"""Whitening of embeddings: the leading components of their covariance, each scaled to variance 1.

Entries become whole numbers, so every sum over the corpus is exact, whatever the partitioning.
Vectors are centred at the whole number next to the mean before they are multiplied, and the rest of the
mean, under one half, is taken off the summed products exactly. Tasks hand on one sum per pair of
dimensions; what reaches the driver is the covariance, whose size depends on the dimensions alone.

There it is made tridiagonal by Householder reflections. Sturm counts say how many eigenvalues lie
below a number, so bisection finds the leading ones; inverse iteration finds a vector for each, made orthogonal
to those of eigenvalues close by. The components are broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom.llm.common import with_row
from headroom.session import settle

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_EXACT = 2**53  # whole numbers up to here are exact as doubles
_LARGEST = 2**43  # of an entry, so that sums over any corpus stay within their types
_STEPS = 3  # of inverse iteration
_CLOSE = 1e-3  # eigenvalues nearer than this, relative to the largest, form a cluster
_EPS = np.finfo(np.float64).eps


# eigenvalues and vectors of a symmetric matrix -------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal, and the reflections (unit columns) that make a symmetric matrix tridiagonal."""
    a = np.array(matrix, np.float64)
    size = len(a)
    mirrors = np.zeros((size, max(0, size - 2)))
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not np.any(x[1:]):
            continue
        x[0] += np.copysign(length, x[0])
        v = x / np.linalg.norm(x)
        mirrors[k + 1 :, k] = v
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number, by signs of the Sturm sequence."""
    tiny = _EPS * max(1e-300, np.abs(off).max(initial=0), np.abs(diagonal).max(initial=0)) * 1e-3 + 1e-300
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - at - e * e / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, each bisected until doubles lie no closer."""
    size = len(diagonal)
    reach = np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = 2 * _EPS * max(abs(low), abs(high)) + 1e-300
    wanted = size - np.arange(min(most, size))  # the i-th from above has this many values at or below
    lows, highs = np.full(len(wanted), low - margin), np.full(len(wanted), high + margin)
    for _ in range(2000):
        middle = lows + (highs - lows) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            break
        enough = count_below(diagonal, off, middle) >= wanted
        highs, lows = np.where(enough, middle, highs), np.where(enough, lows, middle)
    return lows + (highs - lows) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """``(T - value) x = right``, by elimination with row exchanges; vanishing pivots become tiny ones."""
    size = len(diagonal)
    d, one, two, low, x = diagonal - value, np.r_[off, 0.0], np.zeros(size), off.copy(), right.copy()
    tiny = _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0)) or _EPS
    for i in range(size - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            one[i], d[i + 1] = d[i + 1], one[i]
            two[i], one[i + 1] = one[i + 1], two[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(d[i]) < tiny:
            d[i] = tiny
        factor = low[i] / d[i]
        d[i + 1] -= factor * one[i]
        one[i + 1] -= factor * two[i]
        x[i + 1] -= factor * x[i]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(size - 1, -1, -1):
        x[i] -= one[i] * x[i + 1] if i + 1 < size else 0
        x[i] -= two[i] * x[i + 2] if i + 2 < size else 0
        x[i] /= d[i]
    return x


def leading_pairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as rows; a vector's largest entry is positive."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, most)
    random = np.random.default_rng(1)
    found: list[np.ndarray] = []
    width = _CLOSE * max(np.abs(values).max(initial=0), 1e-300)
    for i, value in enumerate(values):
        first = i  # of the chain of eigenvalues that lie close to one another
        while first and values[first - 1] - values[first] <= width:
            first -= 1
        x = random.standard_normal(len(diagonal))
        for _ in range(_STEPS):
            for _ in range(2):
                for other in found[first:i]:
                    x -= (other @ x) * other
                x /= np.linalg.norm(x)
            x = _solved(diagonal, off, value, x)
            x /= np.linalg.norm(x)
        for _ in range(2):
            for other in found[first:i]:
                x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    vectors = np.stack(found)
    for k in range(mirrors.shape[1] - 1, -1, -1):
        vectors -= 2 * np.outer(vectors @ mirrors[:, k], mirrors[:, k])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.where(largest < 0, -1, 1)[:, None]


# sums over the corpus ----------------------------------------------------------------------------------


def whole_numbers(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Entries of vectors of one length as whole numbers, one row per vector."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)
    scaled = np.floor(SCALE * entries)
    if np.abs(scaled).max(initial=0) > _LARGEST:
        raise ValueError(f"entries of embeddings must be below {_LARGEST // SCALE} in size")
    return scaled.astype(np.int64) + SHIFT


def _complete(table: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows whose vector is there, finite and as long as the longest such vector; and that length."""
    vector = F.col(f"`{column}`")
    known = vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    known = F.coalesce(known, F.lit(False))
    found = table.where(known)
    dimensions = found.agg(F.max(F.size(vector))).first()[0] or 0
    return found.where(F.size(vector) == dimensions), dimensions


def _column_sums(vectors: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension; one row of sums per task is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(dimensions, object)
        for batch in batches:
            numbers = whole_numbers(batch.column(0), dimensions)
            count += len(numbers)
            sums += numbers.sum(axis=0).astype(object)
        places = pa.array(range(-1, dimensions), pa.int32())
        totals = pa.array([Decimal(int(s)) for s in (count, *sums)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([places, totals], ["i", "total"])

    rows = vectors.mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    total = {row["i"]: int(row["total"]) for row in rows}
    return total.get(-1, 0), [total.get(i, 0) for i in range(dimensions)]


def products(numbers: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, as Python numbers; blocks are so small that doubles do not round."""
    largest = int(np.abs(numbers).max(initial=0))
    total = np.zeros((numbers.shape[1],) * 2, object)
    if largest**2 >= _EXACT:  # rare: entries beyond any normal embedding
        exact = numbers.astype(object)
        return total + exact.T @ exact
    rows = max(1, _EXACT // max(1, largest**2))
    for begin in range(0, len(numbers), rows):
        block = numbers[begin : begin + rows].astype(np.float64)
        total += (block.T @ block).astype(np.int64).astype(object)
    return total


def _covariance(vectors: DataFrame, dimensions: int, count: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``count``, each entry rounded once."""
    centre = [(2 * s + count) // (2 * count) for s in sums]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((dimensions, dimensions), object), np.array(centre, np.int64)
        for batch in batches:
            total += products(whole_numbers(batch.column(0), dimensions) - own)
        i, j = np.triu_indices(dimensions)
        values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "total"])

    summed = vectors.mapInArrow(multiply, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    rest = [s - count * c for s, c in zip(sums, centre)]  # of the mean, times count
    found = np.zeros((dimensions, dimensions))
    for row in summed.collect():  # one row per pair of dimensions
        i, j = row["i"], row["j"]
        found[i, j] = found[j, i] = (count * int(row["total"]) - rest[i] * rest[j]) / count**2
    return found


class Whitening(NamedTuple):
    """What was learned: ``scales`` are square roots of the components' variances."""

    count: int
    sums: list[int]
    components: np.ndarray
    scales: np.ndarray
    explained: np.ndarray


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Whitening of all complete vectors. Components without variance (beyond the rank) are left out."""
    complete, dimensions = _complete(table, column)
    vectors = complete.select(F.col(f"`{column}`").alias("v"))
    count, sums = _column_sums(vectors, dimensions)
    if not count or not dimensions:
        return Whitening(count, sums, np.zeros((0, dimensions)), np.zeros(0), np.zeros(0))
    covariance = _covariance(vectors, dimensions, count, sums)
    values, rows = leading_pairs(covariance, components)
    trace = float(np.trace(covariance))
    real = values > 8 * dimensions * _EPS * trace
    return Whitening(count, sums, rows[real], np.sqrt(values[real]), values[real] / trace if trace else values[real])


def _deviations(numbers: np.ndarray, count: int, sums: list[int]) -> list[Decimal]:
    """Exact squared distances to the mean, times the square of the count."""
    whole = np.array(sums, object)
    bound = count * int(np.abs(numbers).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 2**62:
        apart = count * numbers - whole.astype(np.int64)
        if len(sums) * int(np.abs(apart).max(initial=0)) ** 2 < 2**63:
            return [Decimal(int(d)) for d in (apart * apart).sum(axis=1)]
        return [Decimal(sum(int(d) ** 2 for d in row)) for row in apart]
    return [Decimal(sum(int(d) ** 2 for d in row)) for row in count * numbers.astype(object) - whole]


def transform(table: DataFrame, learned: Whitening, column: str = "embedding") -> DataFrame:
    """``row``, ``deviation`` decimal(38,0) and ``whitened``, an array of one double per component."""
    complete, dimensions = _complete(table, column)
    if dimensions != learned.components.shape[1]:
        raise ValueError(f"vectors have {dimensions} entries, those learned from {learned.components.shape[1]}")
    shared = table.sparkSession.sparkContext.broadcast(learned)  # some components: bounded by the dimensions
    rows = with_row(complete).select("row", F.col(f"row.`{column}`").alias("v"))
    schema = T.StructType(
        [rows.schema["row"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        whole = [s // max(1, own.count) for s in own.sums]
        rest = np.array([(s - w * own.count) / max(1, own.count) for s, w in zip(own.sums, whole)])
        for batch in batches:
            numbers = whole_numbers(batch.column(1), dimensions)
            centred = (numbers - np.array(whole, np.int64)).astype(np.float64) - rest
            values = (centred @ own.components.T) / own.scales
            offsets = np.arange(len(numbers) + 1, dtype=np.int32) * len(own.scales)
            whitened = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            deviation = pa.array(_deviations(numbers, own.count, own.sums), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, whitened], schema.names)

    return rows.mapInArrow(project, schema)


def _identity_error(projected: DataFrame, size: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity; means first, then products."""
    at = [F.col("whitened")[i] for i in range(size)]
    means = projected.agg(*[F.avg(a) for a in at]).first()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = projected.agg(*[F.avg((at[i] - means[i]) * (at[j] - means[j])) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whitened(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``row, component, n, deviation, whitened, explained, identity_error`` per complete vector and component.

    ``deviation`` is decimal(38,0). Vectors that are null, hold a null or an entry that is not finite, or are shorter than
    the longest (their last entries are missing) are left out; other columns may hold anything. Equal vectors and
    repeated ids keep their rows. There are fewer components than asked for where the vectors have fewer dimensions or a
    smaller rank: none, and so no rows, for an empty table, a single vector or equal vectors. Components of equal variance
    are any orthogonal ones. An entry of 2^33 or more is an error.
    """
    learned = fit(table, column, components)
    projected = settle(transform(table, learned, column))
    error = _identity_error(projected, len(learned.scales)) if len(learned.scales) else 0.0
    shares = F.array(*[F.lit(float(x)) for x in learned.explained]).cast("array<double>")
    placed = projected.select("row", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return placed.select(
        "row",
        (F.col("place") + 1).alias("component"),
        F.lit(learned.count).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
