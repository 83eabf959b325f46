"""Least-squares problems of very many groups at once: sums of products as one packed array per group, solved in Arrow batches of groups.

The sums are plain aggregates, so they are merged inside every task before the shuffle, and a group of any size becomes one row of q (q + 1) / 2 numbers. The same sums
over a window frame give a sliding problem. Only those rows go to Python, thousands of groups in one NumPy call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import WindowSpec


def products(columns: Sequence[Column], over: WindowSpec | None = None) -> Column:
    """Array of the sums of products of all pairs of columns (upper triangle, row by row), of a group or of a window frame."""
    sums = [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]]
    return F.array(*[s.over(over) if over is not None else s for s in sums])


def matrices(packed: pa.Array | pa.ChunkedArray, q: int) -> np.ndarray:
    """The packed arrays as symmetric matrices; nulls become 0."""
    size = q * (q + 1) // 2
    flat = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    values = np.nan_to_num(flat.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, size)
    out = np.empty((len(values), q, q))
    rows, cols = np.triu_indices(q)
    out[:, rows, cols] = values
    out[:, cols, rows] = values
    return out


def solved(groups: DataFrame, solve: Callable[[pa.RecordBatch], dict[str, np.ndarray | pa.Array]], keep: list[str], schema: str) -> DataFrame:
    """``groups`` with the columns that ``solve`` makes of each Arrow batch in place of the others but ``keep``; ``schema`` describes the new ones."""
    kept = [f"{c} {groups.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = solve(batch)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[v if isinstance(v, pa.Array) else pa.array(v, from_pandas=v.dtype.kind == "f") for v in new.values()]], names=[*keep, *new])

    return groups.mapInArrow(run, ", ".join([*kept, schema]))


def centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and covariances of problems whose first column is 1."""
    n = g[:, 0, 0]
    safe = np.maximum(n, 1)
    mean = g[:, 0, 1:] / safe[:, None]
    return n, mean, g[:, 1:, 1:] / safe[:, None, None] - mean[:, :, None] * mean[:, None, :]


def least_squares(c: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 0.0) -> np.ndarray:
    """Coefficients from covariances of the regressors and with the outcome, all groups at once; of several solutions the smallest.

    Directions in which a group's regressors hardly vary (measured in their own units) get no weight.
    """
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", c), 0))
    scale = np.where(scale > 0, scale, 1.0)
    eye = np.eye(c.shape[1])[None]
    if np.any(np.asarray(ridge) > 0):
        return np.linalg.solve(c + np.reshape(ridge, (-1, 1, 1)) * eye, y[:, :, None])[:, :, 0]
    inverse = np.linalg.pinv(c / (scale[:, :, None] * scale[:, None, :]), rcond=1e-10, hermitian=True)
    return np.einsum("gij,gj->gi", inverse, y / scale) / scale


def coordinate_descent(c: np.ndarray, y: np.ndarray, l1: float, l2: float, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Minimiser of w'Cw / 2 - y'w + l1 |w| + l2 |w|^2 / 2 for all groups at once, one coordinate after the other."""
    w, diagonal = np.zeros_like(y), np.einsum("gii->gi", c)
    size = np.abs(y).max(axis=1) + 1e-300
    for _ in range(rounds):
        moved = np.zeros(len(w))
        for j in range(y.shape[1]):
            rest = y[:, j] - np.einsum("gk,gk->g", c[:, j], w) + diagonal[:, j] * w[:, j]
            down = diagonal[:, j] + l2
            new = np.where(down > 1e-300, np.sign(rest) * np.maximum(np.abs(rest) - l1, 0) / np.maximum(down, 1e-300), 0.0)
            moved = np.maximum(moved, np.abs(new - w[:, j]) * diagonal[:, j])
            w[:, j] = new
        if (moved <= tolerance * size).all():
            break
    return w


def nested_errors(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared errors of the last column on the first 1, 2 ... columns, and the triangular factor, from one factorisation of all nested problems.

    The factor is built column by column; a column that depends on those before it adds nothing.
    """
    q = g.shape[1]
    low = np.zeros_like(g)
    for j in range(q):
        left = g[:, :, j] - np.einsum("gik,gk->gi", low[:, :, :j], low[:, j, :j])
        pivot = left[:, j]
        good = pivot > 1e-10 * np.maximum(g[:, j, j], 1e-300)
        root = np.sqrt(np.where(good, pivot, 1.0))
        low[:, j:, j] = np.where(good[:, None], left[:, j:] / root[:, None], 0.0)
    explained = np.cumsum(low[:, q - 1, :q - 1] ** 2, axis=1)
    return np.maximum(g[:, -1, -1][:, None] - explained, 0.0), low
