"""Time warping of very many pairs of series at once: one step a diagonal for all pairs of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelloom.functions import gram

#: Cells that the padded arrays of one call may hold.
MOST_CELLS = 4_000_000


def _scaled(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows scaled to 0..1 over their first ``length`` places; the padding becomes NaN."""
    v = np.where(np.arange(v.shape[1])[None] < length[:, None], v, np.nan)
    low, high = np.nanmin(v, axis=1), np.nanmax(v, axis=1)
    return (v - low[:, None]) / (high - low + 1e-8)[:, None]


def least_distances(a: np.ndarray, b: np.ndarray, length: np.ndarray, band: int | None) -> np.ndarray:
    """A bound that no path undercuts: every value is matched with one that the band lets it reach, the first values with each other alone."""
    size = a.shape[1]
    place = np.arange(size)[None]
    reach = size if band is None else band
    out = np.zeros(len(a))
    for own, other in ((a, b), (b, a)):
        tail = other.copy()
        tail[:, 0] = np.nan
        low, high = np.where(np.isnan(tail), np.inf, tail), np.where(np.isnan(tail), -np.inf, tail)
        width = 1
        while width <= min(reach, size):  # windows of doubled width, the last one overlapping
            step = min(width, reach - width + 1)
            if step <= 0:
                break
            for edge, pick, empty in ((low, np.minimum, np.inf), (high, np.maximum, -np.inf)):
                left, right = np.full_like(edge, empty), np.full_like(edge, empty)
                left[:, step:], right[:, :-step] = edge[:, :-step], edge[:, step:]
                edge[:] = pick(edge, pick(left, right))
            width += step
        with np.errstate(invalid="ignore"):
            apart = np.where(np.isfinite(low), np.maximum(np.maximum(own - high, low - own), 0), 0)
        apart = np.where((place > 0) & (place < length[:, None]), apart, 0)
        out = np.maximum(out, np.abs(a[:, 0] - b[:, 0]) + apart.sum(axis=1))
    return out


def distances(a: np.ndarray, b: np.ndarray, length: np.ndarray, band: int | None) -> np.ndarray:
    """Warping distances of the rows of ``a`` and ``b`` over their first ``length`` places.

    Cell (i, j) costs |a_i - b_j| plus the cheapest of its left, upper and diagonal neighbours; the first values are matched with each other alone. All cells of one i + j depend on
    the two diagonals before only, so a diagonal of all rows is one array operation. Shorter rows have their distance on an earlier diagonal, which the padding cannot reach.
    """
    size = a.shape[1]
    two, one, now = (np.full((len(a), size + 2), np.inf) for _ in range(3))
    one[:, 0] = np.abs(a[:, 0] - b[:, 0])
    out = np.where(length == 1, one[:, 0], np.inf)
    reach = size if band is None else band
    backwards = b[:, ::-1]
    # ``one`` holds diagonal 0; diagonal 1 has no cell of its own.
    two, one = one, two
    for k in range(2, 2 * size - 1):
        lo, hi = max(1, k - size + 1, -((reach - k) // 2)), min(size - 1, k - 1, (k + reach) // 2)
        now[:, max(lo - 2, 0):lo] = np.inf
        now[:, hi + 1:hi + 3] = np.inf
        if lo <= hi:
            cost = np.abs(a[:, lo:hi + 1] - backwards[:, size - 1 - k + lo:size - k + hi])
            now[:, lo:hi + 1] = cost + np.minimum(np.minimum(one[:, lo:hi + 1], one[:, lo - 1:hi]), two[:, lo - 1:hi])
        if k % 2 == 0:
            ends = length == k // 2 + 1
            out[ends] = now[ends, k // 2]
        two, one, now = one, now, two
    return out


def similarities(df: DataFrame, key: list[str], order_by: str, x: str, y: str, band: int | None = None, at_least: float | None = None) -> DataFrame:
    """(key…, n, similarity, below): 1 minus the warping distance of the min-max scaled series over 2n, held between -1 and 1.

    Rows in which either value is null or NaN are left out; a key without another row gives none. With ``band`` only places at most so far apart are matched. With ``at_least``, pairs
    under it have ``below`` true and no similarity; most of them are told by a bound that needs no warping. A key's history has one row a period and becomes two arrays; histories of
    like length are warped together, thousands at a time, in calls of bounded memory.
    """
    whole = df.select(*key, F.col(order_by).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    paths = whole.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_o", "_x", "_y"))).alias("_p"))
    paths = paths.select(*key, F.transform("_p", lambda p: p["_x"]).alias("_a"), F.transform("_p", lambda p: p["_y"]).alias("_b"))

    def solve(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        left, right = batch.column("_a"), batch.column("_b")
        start = left.offsets.to_numpy()
        n = np.diff(start)
        flat_a, flat_b = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
        begin_b = right.offsets.to_numpy()
        found = np.full(len(n), np.nan)
        order = np.argsort(n, kind="stable")
        at = 0
        while at < len(order):
            # rows of one call: lengths within a quarter of each other, so little is padding
            top = np.searchsorted(n[order], n[order[at]] * 1.25 + 1, side="right")
            top = min(top, at + max(1, MOST_CELLS // int(n[order[top - 1]])))
            own, at = order[at:top], top
            size = int(n[own].max())
            place = np.minimum(np.arange(size)[None], n[own][:, None] - 1)
            a, b = _scaled(flat_a[start[own][:, None] + place], n[own]), _scaled(flat_b[begin_b[own][:, None] + place], n[own])
            if at_least is not None:
                good = 1 - least_distances(a, b, n[own], band) / (2 * n[own]) >= at_least - 1e-12
                own, a, b = own[good], a[good], b[good]
            if len(own):
                with np.errstate(invalid="ignore"):
                    found[own] = 1 - distances(a, b, n[own], band) / (2 * n[own])
        found = np.where(np.isfinite(found), np.clip(found, -1, 1), np.nan)
        below = np.zeros(len(n), bool) if at_least is None else ~(found >= at_least)
        return {"n": n.astype(np.int64), "similarity": np.where(below, np.nan, found), "below": below}

    return gram.solved(paths, solve, key, "n long, similarity double, below boolean")
