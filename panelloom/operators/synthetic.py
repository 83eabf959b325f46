"""Synthetic controls whose weights minimise the squared error before the intervention, for any number of markets and controls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.functions import gram
from panelloom.functions.session import cut_lineage
from panelloom.roles import DEFAULT, Roles

#: Groups of controls of a market, each of which offers its best control in a round. It splits a market that holds most controls, and saves rounds.
OFFERS = 16
#: Duality gap, as a share of the treated series' sum of squares, at which a market is finished.
GAP = 1e-9
MOST_ROUNDS = 60


def nearest_in_hull(points: np.ndarray, start: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """Weights (not negative, sum 1) of the rows of ``points`` whose mean lies nearest to the origin, by Wolfe's corral method.

    ``start`` holds the weights of an earlier solution over the same rows, zero for new ones. In each step the row that leads farthest towards the origin joins the corral; then the
    nearest point of the corral's affine hull is taken, and rows leave while it has a negative weight.
    """
    scale = max(float((points * points).sum(axis=1).max()), 1e-300)
    w = np.where(start > 0, start, 0.0)
    if w.sum() <= 0:
        w = np.zeros(len(points))
        w[np.argmin((points * points).sum(axis=1))] = 1.0
    w = w / w.sum()
    corral = list(np.flatnonzero(w))
    best = np.inf
    while True:
        for _ in range(len(points) + 1):  # nearest point of the corral's affine hull, rows leave until it is inside
            own = points[corral]
            k = len(corral)
            system = np.ones((k + 1, k + 1))
            system[:k, :k] = own @ own.T / scale
            system[k, k] = 0.0
            right = np.zeros(k + 1)
            right[k] = 1.0
            affine = np.linalg.lstsq(system, right, rcond=1e-14)[0][:k]
            now = w[corral]
            if (affine > 0).all():
                w[corral] = affine / affine.sum()
                break
            down = affine <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - affine[down], 1e-300)))
            moved = np.maximum(now + min(step, 1.0) * (affine - now), 0.0)
            moved[np.flatnonzero(down)[np.argmin(now[down] / np.maximum(now[down] - affine[down], 1e-300))]] = 0.0
            w[:] = 0.0
            w[corral] = moved
            w /= w.sum()
            corral = [j for j in corral if w[j] > 0]
        mean = w @ points
        ahead = points @ mean
        size = float(mean @ mean)
        j = int(np.argmin(ahead))
        if size - ahead[j] <= tolerance * scale or j in corral or size >= best:
            return w
        best = size
        corral.append(j)


def _shifted(control: Column, treated: Column) -> Column:
    return F.zip_with(control, treated, lambda c, t: c - t)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fitted_weights(df: DataFrame, treated: int, start: int, roles: Roles = DEFAULT, gap: float = GAP, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(by…, id, weight, gap, rounds): weights of at least 0 and sum 1 a market that bring the controls nearest to the treated entity before ``start``.

    The fit is a conditional-gradient descent over all controls: a round is one aggregate in which each of ``OFFERS`` groups of a market's controls offers the one with the lowest
    slope. The offers join the few controls in use (at most one more than there are periods), the weights of those are solved exactly, and only the ones used are kept. What goes
    from round to round is one row a market. ``gap`` is the duality gap as a share of the treated series' sum of squares, measured over all controls: the error exceeds the optimum by no
    more. Rounds stop when every market is within ``gap``; ``most_rounds`` only guards against rounding, and the gap in the result tells.

    A control needs a value in every period before ``start`` that the treated entity has; others take no part. The treated entity's periods without a value are left out. Markets
    without the treated entity, without a period before ``start`` or without such controls give no rows. Where several weightings reach the minimum, the rounds end at one of
    them, the same in each run. An entity has at most one row a period.
    """
    y, v, by = roles.year, roles.value, list(roles.by)
    keys = by or ["_all"]
    rows = df.select(*roles.entity, y, F.col(v).cast("double").alias("_v")).where((F.col(y) < start) & F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    path = F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col("_v").alias("v"))))
    target = rows.where(F.col(roles.id) == treated).groupBy(*keys).agg(path.alias("_p"))
    target = target.select(*keys, F.transform("_p", lambda p: p["y"]).alias("_years"), F.transform("_p", lambda p: p["v"]).alias("_t"))
    target = target.withColumn("_norm", F.greatest(_dot(F.col("_t"), F.col("_t")), F.lit(1e-300)))
    own = rows.where(F.col(roles.id) != treated).groupBy(*keys, roles.id).agg(path.alias("_p")).join(target, keys)
    at = F.map_from_entries(F.transform("_p", lambda p: F.struct(p["y"], p["v"])))
    own = own.withColumn("_c", F.transform(F.col("_years"), lambda year: F.try_element_at(at, year))).where(~F.exists("_c", lambda c: c.isNull()))
    controls = cut_lineage(own.select(*keys, roles.id, F.pmod(F.xxhash64(roles.id), F.lit(OFFERS)).alias("_group"), _shifted(F.col("_c"), F.col("_t")).alias("_d")))

    def offers(scored: DataFrame) -> DataFrame:
        """The control of the lowest score of each group; equal scores go to the lowest id."""
        best = scored.groupBy(*keys, "_group").agg(F.min(F.struct(F.col("_score").alias("s"), F.col(roles.id).alias("id"), F.col("_d").alias("d"))).alias("_b"))
        return best.groupBy(*keys).agg(F.min("_b.s").alias("_low"), F.array_sort(F.collect_list(F.struct("_b.id", "_b.d"))).alias("_new"))

    id_type, kept = df.schema[roles.id].dataType.simpleString(), f"array<struct<id:{df.schema[roles.id].dataType.simpleString()},d:array<double>>>"

    def solve(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        atoms, used, means = [], [], []
        for old, w, new in zip(batch.column("_atoms").to_pylist(), batch.column("_w").to_pylist(), batch.column("_new").to_pylist()):
            known = {a["id"] for a in old}
            all_ = [*old, *[a for a in new or [] if a["id"] not in known]]
            points = np.array([a["d"] for a in all_], dtype=float)
            weights = nearest_in_hull(points, np.array([*w, *[0.0] * (len(all_) - len(w))]))
            on = np.flatnonzero(weights > 0)
            atoms.append([all_[j] for j in on])
            used.append([float(weights[j]) for j in on])
            means.append([float(x) for x in weights @ points])
        like = batch.schema.field("_atoms").type
        return {"_atoms": pa.array(atoms, like), "_w": pa.array(used, pa.list_(pa.float64())), "_x": pa.array(means, pa.list_(pa.float64()))}

    shape = f"_atoms {kept}, _w array<double>, _x array<double>"
    # The first offers are the nearest controls.
    first = offers(controls.withColumn("_score", _dot(F.col("_d"), F.col("_d"))))
    first = first.join(target.select(*keys, "_norm"), keys)
    empty = first.select(*keys, "_norm", F.slice("_new", 1, 0).alias("_atoms"), F.array().cast("array<double>").alias("_w"), "_new")
    state = cut_lineage(gram.solved(empty, solve, [*keys, "_norm"], shape))
    done = None
    for turn in range(1, most_rounds + 1):
        # Weights, slopes and gap: x is the mean of the shifted controls, the slope towards a control is d.x, the gap x.x - min d.x.
        slopes = controls.join(state.select(*keys, "_x"), keys).withColumn("_score", _dot(F.col("_d"), F.col("_x")))
        found = offers(slopes).join(state, keys)
        found = found.withColumn("gap", F.greatest(2 * (_dot(F.col("_x"), F.col("_x")) - F.col("_low")), F.lit(0.0)) / F.col("_norm"))
        found = cut_lineage(found)
        last = turn == most_rounds
        finished = found.where(F.lit(last) | (F.col("gap") <= gap)).select(*keys, "_atoms", "_w", "gap", F.lit(turn).alias("rounds"))
        done = finished if done is None else done.unionByName(finished)
        open_ = found.where(F.col("gap") > gap)
        if last or open_.isEmpty():
            break
        state = cut_lineage(gram.solved(open_, solve, [*keys, "_norm"], shape))
    out = done.select(*keys, F.inline(F.arrays_zip(F.col("_atoms.id").alias("id"), F.col("_w").alias("weight"))), "gap", "rounds")
    return out.select(*by, F.col("id").cast(id_type).alias(roles.id), "weight", "gap", "rounds")


def fitted_control(df: DataFrame, treated: int, start: int, roles: Roles = DEFAULT, gap: float = GAP) -> dict[str, DataFrame]:
    """Weights of ``fitted_weights``, the path (by…, year, treated, synthetic, effect) over all periods, and per market average and cumulative effect from ``start`` on and pre_r2.

    In a period in which a control of the sum has no value, the weights of the others are scaled up to 1; without any, ``synthetic`` and ``effect`` are null. A treated series without
    variance before ``start`` has no pre_r2.
    """
    y, v, by = roles.year, roles.value, list(roles.by)
    weights = fitted_weights(df, treated, start, roles, gap)
    weights = cut_lineage(weights)
    value = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    unit = df.where(F.col(roles.id) == treated).select(*roles.period, value.alias("treated")).where("treated is not null")
    used = df.where(F.col(roles.id) != treated).select(*roles.entity, y, value.alias("_c")).where("_c is not null").join(weights.select(*roles.entity, "weight"), roles.entity)
    sums = used.groupBy(*roles.period).agg(F.try_divide(F.sum(F.col("weight") * F.col("_c")), F.sum("weight")).alias("synthetic"))
    path = unit.join(sums, roles.period, "left").withColumn("effect", F.col("treated") - F.col("synthetic"))
    path = path.join(weights.select(*by).distinct(), by, "left_semi") if by else path
    before, e = F.col(y) < start, F.col("effect")
    pre = F.when(before, F.col("treated"))
    effect = path.groupBy(*by).agg(F.avg(F.when(~before, e)).alias("average_effect"), F.sum(F.when(~before, e)).alias("cumulative_effect"),
                                   (1 - F.try_divide(F.sum(F.when(before, e * e)), F.var_pop(pre) * F.count(pre))).alias("pre_r2"))
    return {"weights": weights, "path": path, "effect": effect}
