"""Least squares per series from sums of products.

A regression needs only the products of its columns summed over rows. Each task sums
them for the rows it holds, so what is shuffled after that is a few thousand numbers per
series and task, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.session import settle

ROWS_PER_PART = 200_000
_ROWS_OUT = 256  # finished series a task hands on at a time


def _key_fields(df: DataFrame, series: Sequence[str]) -> str:
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in series)


def _sum_products(series: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products per series of rows that arrive sorted by series: one sum is open at a time."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, np.ndarray]] = []
        current, total, schema = None, None, None

        def release() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key, _ in done], schema.field(name).type) for i, name in enumerate(series)]
            upper = np.triu_indices(done[0][1].shape[0])
            values = pa.array([block[upper] for _, block in done], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*columns, values], names=[*series, "products"])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            rows = np.asarray(batch.column("z").flatten()).reshape(batch.num_rows, -1)
            keys = pd.DataFrame({name: batch.column(name).to_pandas() for name in series})
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(name)[int(begin)].as_py() for name in series)
                block = rows[begin:end].T @ rows[begin:end]
                if key == current:
                    total = total + block
                    continue
                if current is not None:
                    done.append((current, total))
                current, total = key, block
            if len(done) >= _ROWS_OUT:
                yield release()
                done = []
        if current is not None:
            done.append((current, total))
            yield release()

    return sums


def products(
    df: DataFrame,
    design: Sequence[Column],
    target: Column,
    *,
    series: Sequence[str],
    spread: str = "ds",
    rows: int = ROWS_PER_PART,
) -> DataFrame:
    """One row per series: ``products``, the upper triangle of the products of design and target.

    ``df`` should hold only the columns the design needs: rows are brought together by
    series, long series in parts by a hash of ``spread``, before the design is computed.
    The sums of the parts of long series are added up number by number, so no task sees
    more than partial sums of a series.
    """
    series = list(series)
    fields = f"{_key_fields(df, series)}, products array<double>"
    parts = F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int")
    sizes = settle(df.groupBy(*series).agg(parts.alias("_parts")))
    keys = [F.col(c) for c in series]

    def partial(part_of: DataFrame, *salt: Column) -> DataFrame:
        placed = part_of.repartition(*keys, *salt).sortWithinPartitions(*series)
        wide = placed.select(*series, F.array(*design, target.cast("double")).alias("z"))
        return wide.mapInArrow(_sum_products(series), fields)

    if sizes.where("_parts > 1").isEmpty():
        return partial(df)
    sized = df.join(sizes, series)
    summed = (
        partial(sized.where("_parts > 1"), F.pmod(F.xxhash64(spread), F.col("_parts")))
        .select(*series, F.posexplode("products").alias("_at", "_value"))
        .groupBy(*series, "_at")
        .agg(F.sum("_value").alias("_value"))
        .groupBy(*series)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_value"))), lambda e: e["_value"]).alias("products"))
    )
    return partial(sized.where("_parts = 1")).unionByName(summed)


def square(triangle: Sequence[float]) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = triangle
    return matrix + np.triu(matrix, 1).T


def ridges(matrix: np.ndarray) -> Callable[[np.ndarray | float], np.ndarray]:
    """Coefficients of the last column on the others as a function of the penalty; columns that are all zero get 0.

    Several matrices may be stacked.
    """
    left, right = matrix[..., :-1, :-1], matrix[..., :-1, -1]
    shape, scale = right.shape, np.sqrt(np.diagonal(left, axis1=-2, axis2=-1))
    some = np.flatnonzero((scale > 0).reshape(-1, shape[-1]).any(axis=0))
    if len(some) < shape[-1]:
        left, right, scale = left[..., some[:, None], some], right[..., some], scale[..., some]
    used = scale > 0
    unit = np.where(used, scale, 1.0)
    core, goal = left / (unit[..., :, None] * unit[..., None, :]), right / unit
    if not used.all():  # a column that one matrix lacks stands alone there
        core, goal = np.where(used[..., :, None] & used[..., None, :], core, 0.0), np.where(used, goal, 0.0)
    places = np.arange(len(some))

    def solved(penalty: np.ndarray | float) -> np.ndarray:
        own, out = core.copy(), np.zeros(shape)
        own[..., places, places] += np.where(used, np.broadcast_to(penalty, shape)[..., some] / unit**2 + 1e-10, 1.0)
        out[..., some] = np.linalg.solve(own, goal[..., None])[..., 0] / unit
        return out

    return solved


def ridge(matrix: np.ndarray, penalty: np.ndarray | float) -> np.ndarray:
    return ridges(matrix)(penalty)


def sparse(matrix: np.ndarray, penalty: np.ndarray, absolute: np.ndarray, sweeps: int = 10_000) -> np.ndarray:
    """Coefficients with squared penalties on all columns and, beside them, penalties on the size of some.

    Minimises half the squared error plus ``penalty / 2 * b^2 + absolute * |b|``. Columns without ``absolute`` are
    solved for exactly and leave the sums; the others follow by coordinate descent, which ends when the linear system
    of the columns that are not zero, with their signs, meets all conditions of the minimum.
    """
    left, right = matrix[:-1, :-1].copy(), matrix[:-1, -1]
    scale = np.sqrt(np.diag(left))
    used = scale > 0
    out = np.zeros(len(right))
    if not used.any():
        return out
    unit = scale[used]
    core = left[np.ix_(used, used)] / np.outer(unit, unit) + np.diag(penalty[used] / unit**2 + 1e-10)
    goal, weight = right[used] / unit, absolute[used] / unit
    bent, plain = np.flatnonzero(weight > 0), np.flatnonzero(weight == 0)
    solved = np.linalg.solve(core[np.ix_(plain, plain)], np.column_stack([core[np.ix_(plain, bent)], goal[plain]])) if len(plain) else np.zeros((0, len(bent) + 1))
    inner = core[np.ix_(bent, bent)] - core[np.ix_(bent, plain)] @ solved[:, :-1]
    wanted, weight = goal[bent] - core[np.ix_(bent, plain)] @ solved[:, -1], weight[bent]
    found, slack = np.zeros(len(bent)), 1e-9 * (1 + np.abs(wanted).max(initial=0))
    for sweep in range(sweeps):
        moved = 0.0
        for j in range(len(bent)):
            rest = wanted[j] - inner[j] @ found + inner[j, j] * found[j]
            new = np.sign(rest) * max(abs(rest) - weight[j], 0.0) / inner[j, j]
            moved, found[j] = max(moved, abs(new - found[j])), new
        if sweep % 10 == 9 or moved < 1e-14:
            active, signs = np.flatnonzero(found), np.sign(found)
            exact = np.zeros(len(bent))
            if len(active):
                exact[active] = np.linalg.solve(inner[np.ix_(active, active)], wanted[active] - weight[active] * signs[active])
            slope = wanted - inner @ exact
            if np.all(exact[active] * signs[active] > 0) and np.all(np.abs(slope) <= weight + slack):
                found = exact
                break
            if moved < 1e-14:
                break
    both = np.zeros(len(goal))
    both[bent] = found
    both[plain] = solved[:, -1] - solved[:, :-1] @ found
    out[used] = both / unit
    return out


def residual_variance(matrix: np.ndarray, coefficients: np.ndarray, rows: float | np.ndarray) -> np.ndarray:
    inner = np.matmul(matrix[..., :-1, :-1], coefficients[..., None])[..., 0] - 2 * matrix[..., :-1, -1]
    loss = matrix[..., -1, -1] + (coefficients * inner).sum(axis=-1)
    return np.maximum(loss / np.maximum(rows, 1.0), 1e-10)


def solve(
    table: DataFrame,
    solver: Callable[[np.ndarray, pd.Series], dict[str, list[float]]],
    outputs: Sequence[str],
    *,
    keep: Sequence[str],
) -> DataFrame:
    """Apply ``solver(matrix, row)`` to each row of a table with ``products``; adds array columns."""
    keep, outputs = list(keep), list(outputs)
    fields = ", ".join([_key_fields(table, keep), *[f"{name} array<double>" for name in outputs]])

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = [solver(square(row["products"]), row) for _, row in frame.iterrows()]
            out = frame[keep].reset_index(drop=True)
            for name in outputs:
                out[name] = [result[name] for result in results]
            yield out

    return table.mapInPandas(solved, fields)


def dot(columns: Sequence[Column], coefficients: str) -> Column:
    """Sum of columns times the coefficients in an array column, as one expression."""
    terms = [column * F.get(F.col(coefficients), F.lit(i)) for i, column in enumerate(columns)]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]
