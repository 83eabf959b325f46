"""Trajectory harmonisation: smooth each entity's path across the border between history and forecast.

An entity's path is one array of at most one value per period, so every step is an array expression on one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, order
from panelloom.functions.session import calendar_side
from panelloom.operators.regions import WORLD_TERMS, sum_regions
from panelloom.roles import DEFAULT, HarmonizeSettings, Roles


def growth_table(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Growth in % per entity-year; the first year of an entity is left out."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    before = F.lag(roles.value).over(w)
    return (df.withColumn("_n", F.row_number().over(w)).withColumn("growth_rate", (F.try_divide(F.col(roles.value), before) - 1) * 100)
            .where("_n > 1").drop("_n"))


def forecast_start(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(by…, last_historical): the year before the largest relative jump of the median and deviation of growth over entities."""
    g = growth_table(df, roles)
    keys = list(roles.by)
    stats = order.quantiles(g, roles.period, "growth_rate", {"m": 0.5}).join(g.groupBy(*roles.period).agg(F.stddev_samp("growth_rate").alias("s")), roles.period)
    w = W.partitionBy(*keys).orderBy(roles.year)

    def jump(c: str) -> Column:
        before = F.lag(c).over(w)
        move = F.abs(F.col(c) - before)
        return F.when(before != 0, move / F.abs(before)).otherwise(move)

    rows = stats.withColumn("_j", jump("m") + jump("s")).withColumn("_years", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    best = F.max_by(F.col(roles.year), F.when(F.col("_j").isNotNull(), F.struct("_j", -F.col(roles.year))))
    span = F.floor((F.min(roles.year) - 1 + F.max(roles.year) + 1) / 2).cast("int")
    return rows.groupBy(*keys).agg(F.when(F.max("_years") < 3, span).otherwise(best - 1).alias("last_historical"))


def paths(df: DataFrame, last_historical: int, roles: Roles = DEFAULT, extra: list[str] | None = None) -> DataFrame:
    """One row per entity: years ``_y``, values ``_v``, length ``_n``, number of historical years ``_h``."""
    extra = extra or []
    rows = folds.ordered_rows(df, [*roles.entity, *extra], roles.year, [roles.value])
    return rows.select(*roles.entity, *extra, F.transform("_rows", lambda x: x[roles.year]).alias("_y"), F.transform("_rows", lambda x: x[roles.value].cast("double")).alias("_v"),
                       F.size("_rows").alias("_n"), F.size(F.filter("_rows", lambda x: x[roles.year] <= last_historical)).alias("_h"))


def unfold(df: DataFrame, columns: dict[str, str], roles: Roles = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """Back to one row per entity-year with the named arrays as columns."""
    zipped = F.arrays_zip(F.col("_y").alias("y"), *[F.col(a).alias(f"c{i}") for i, a in enumerate(columns)])
    out = df.select(*roles.entity, *(keep or []), F.explode(zipped).alias("_e"))
    return out.select(*roles.entity, *(keep or []), F.col("_e.y").alias(roles.year), *[F.col(f"_e.c{i}").alias(name) for i, name in enumerate(columns.values())])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def gaussian(values: Column, sigma: Column) -> Column:
    """Gaussian mean over a window of four sigmas; beyond an end the path is mirrored."""
    n = F.size(values)
    radius = (4 * sigma + 0.5).cast("int")
    offsets = F.sequence(-radius, radius)
    kernel = F.transform(offsets, lambda o: F.exp(-(o * o) / (2 * sigma * sigma)))
    total = _sum(kernel)

    def at(i: Column, o: Column) -> Column:
        j = F.pmod(i + o, 2 * n)
        return F.get(values, F.when(j < n, j).otherwise(2 * n - 1 - j))

    return F.when(n > 0, F.transform(values, lambda _, i: F.aggregate(offsets, F.lit(0.0), lambda s, o: s + F.exp(-(o * o) / (2 * sigma * sigma)) * at(i, o)) / total)).otherwise(values)


def smooth_gaussian(v: Column, n: Column, h: Column, strength: Column, boundary: str = "strict") -> Column:
    """History and forecast smoothed apart (0.7 and 1.3 times sigma) when each has more than three years."""
    sigma = F.greatest(F.lit(0.5), strength * 3.0)
    past, ahead = F.slice(v, 1, h), F.slice(v, h + 1, n - h)
    if boundary == "strict":
        apart = F.concat(F.when(h > 3, gaussian(past, sigma * 0.7)).otherwise(past), F.when(n - h > 3, gaussian(ahead, sigma * 1.3)).otherwise(ahead))
        out = F.when(n > h, apart).otherwise(gaussian(v, sigma))
    else:
        out = gaussian(v, sigma)
    return F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))


def _window_mean(v: Column, i: Column, low: Column, high: Column, n: Column) -> Column:
    lo, hi = F.greatest(low, F.lit(0)), F.least(high, n - 1)
    part = F.slice(v, lo + 1, hi - lo + 1)
    return F.try_divide(_sum(part), F.size(part).cast("double"))


def smooth_rolling(v: Column, n: Column, strength: Column) -> Column:
    """Blend with the centred rolling mean. An interpolating curve read at its own knots returns the knots, so none is needed."""
    w = F.greatest(F.least(F.greatest(F.lit(3), F.floor(n * strength * 0.3).cast("int") * 2 + 1), n - 1), F.lit(1))
    off = F.floor((w - 1) / 2).cast("int")
    out = F.transform(v, lambda x, i: (1 - strength) * x + strength * _window_mean(v, i, i - w + 1 + off, i + off, n))
    return F.when(strength > 0, F.transform(out, lambda x: F.greatest(x, F.lit(0.0)))).otherwise(v)


def smooth_monotone(v: Column, n: Column, h: Column, strength: Column) -> Column:
    """Windowed mean on history, then a shape-preserving curve on a five times finer grid with a Gaussian, read back at the years."""
    def slopes(x, y):
        step, d = np.diff(x), np.diff(y) / np.diff(x)
        if len(x) == 2:
            return np.array([d[0], d[0]])
        m = np.zeros_like(y)
        w1, w2 = 2 * step[1:] + step[:-1], step[1:] + 2 * step[:-1]
        same = np.sign(d[:-1]) * np.sign(d[1:]) > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

        def edge(h0, h1, d0, d1):
            e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if np.sign(e) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0) else e

        m[0], m[-1] = edge(step[0], step[1], d[0], d[1]), edge(step[-1], step[-2], d[-1], d[-2])
        return m

    def curve(x, y, at):
        m = slopes(x, y)
        k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
        s = x[k + 1] - x[k]
        t = (at - x[k]) / s
        return ((1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * s * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * s * m[k + 1])

    def blur(y, sigma):
        r = int(4 * sigma + 0.5)
        o = np.arange(-r, r + 1)
        k = np.exp(-o * o / (2 * sigma * sigma))
        idx = np.mod(np.arange(len(y))[:, None] + o, 2 * len(y))
        idx = np.where(idx < len(y), idx, 2 * len(y) - 1 - idx)
        return (y[idx] * (k / k.sum())).sum(axis=1)

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, hist: pd.Series, strength: pd.Series) -> pd.Series:
        out = []
        for y, hh, s in zip(values, hist, strength):
            y = np.asarray(y, float)
            count = len(y)
            if count < 2 or not np.isfinite(y).all():
                out.append(y)
                continue
            x, base = np.arange(count, dtype=float), y.copy()
            half = min(max(3, int(count * s * 0.2) * 2 + 1), count - 1) // 2
            if s > 0:
                for i in range(half, min(hh, count - half)):
                    base[i] = y[i - half:i + half + 1].mean()
            grid = np.linspace(0, count - 1, count * 5)
            fine = curve(x, base, grid)
            out.append(np.maximum(curve(grid, blur(fine, max(1.0, s * 5.0)) if s > 0 else fine, x), 0.0))
        return pd.Series(out)

    return run(v, h, strength)


def inflections(df: DataFrame, sensitivity: float = 0.6, minimum: float = 0.2, roles: Roles = DEFAULT) -> DataFrame:
    """Sign changes of the second difference whose prominence, relative to the value, passes the bound (paths of five years or more)."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    v = F.col(roles.value)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*roles.entity))).withColumn("_d", v - 2 * F.lag(v).over(w) + F.lag(v, 2).over(w))
    rows = rows.withColumn("_a", F.lag("_d").over(w)).withColumn("_b", F.lead("_d").over(w))
    height = (F.abs(F.col("_d") - F.col("_a")) + F.abs(F.col("_b") - F.col("_d"))) / 2
    rows = rows.withColumn("prominence", F.when(v > 0, height / v).otherwise(height))
    return rows.where((F.col("_n") >= 5) & (F.col("_a") * F.col("_d") < 0) & (F.col("prominence") > minimum * (2 - sensitivity))).select(*roles.entity, roles.year, roles.value, "prominence")


def gradient_inflections(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Sign changes of the second central gradient, marked at the row before the change with the direction of the change."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)

    def gradient(c: str) -> Column:
        before, after, now = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        return F.when(before.isNull(), after - now).when(after.isNull(), now - before).otherwise((after - before) / 2)

    rows = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*roles.entity))).withColumn("_g", gradient(roles.value))
    rows = rows.withColumn("_s", gradient("_g")).withColumn("_next", F.lead("_s").over(w))
    down, up = F.col("_s") < 0, F.col("_next") < 0
    return (rows.where((F.col("_n") >= 5) & F.col("_next").isNotNull() & (down != up))
            .select(*roles.entity, roles.year, roles.value, F.when(down & (F.col("_next") > 0), "deceleration").otherwise("acceleration").alias("kind")))


def transition(smoothed: Column, v: Column, years: Column, h: Column, last_historical: int, settings: HarmonizeSettings) -> Column:
    """History kept (strict), only its ends kept (relaxed) or free; linear hand-over across the transition zone."""
    zone = settings.transition_zone
    low, high = last_historical - zone + 1, last_historical + zone
    inside = F.filter(years, lambda y: (y >= low) & (y <= high))
    count = F.size(inside)
    edge = F.size(F.filter(inside, lambda y: y <= last_historical)) > 0

    def one(x: Column, i: Column) -> Column:
        orig, y = F.get(v, i), F.get(years, i)
        if settings.boundary == "strict":
            kept = F.when(i < h, orig).otherwise(x)
        elif settings.boundary == "relaxed":
            kept = F.when((i == 0) & (h > 0), orig).when((i == h - 1) & ~edge, orig).otherwise(x)
        else:
            kept = x
        weight = 1 - F.try_divide(F.array_position(inside, y) - 1, count)
        return F.when((y >= low) & (y <= high) & (h > 0) & (h < F.size(v)), weight * orig + (1 - weight) * x).otherwise(kept)

    return F.transform(smoothed, one)


def converge(path: Column, n: Column, h: Column, target: Column) -> Column:
    """Pull forecast growth to the target: the own weight falls to 0 by the middle of the forecast; compounded in sequence."""
    ahead = n - h
    factor = 1 + target / 100

    def step(acc: Column, x: Column) -> Column:
        i = F.size(acc) - h
        before = F.element_at(acc, -1)
        own = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(2 * i, ahead - 1), F.lit(0.0)))
        moved = F.when((i >= 1) & (before > 0), own * x + (1 - own) * factor * before).otherwise(x)
        return F.concat(acc, F.array(moved))

    # The start holds history and the first forecast year, which are never moved.
    run = F.aggregate(F.slice(path, h + 2, F.greatest(ahead - 1, F.lit(0))), F.slice(path, 1, h + 1), step)
    return F.when((ahead >= 3) & (h >= 0), run).otherwise(path)


def _by_tier(table: dict[int, float], default: float) -> Column:
    out = None
    for t, x in table.items():
        if t:
            out = F.when(F.col("tier") == t, x) if out is None else out.when(F.col("tier") == t, x)
    return out.otherwise(default)


def harmonize(df: DataFrame, last_historical: int, settings: HarmonizeSettings = HarmonizeSettings(), roles: Roles = DEFAULT) -> DataFrame:
    """(entity, year, value, harmonized, branch). A ``tier`` column, where present, sets strength and target growth.

    ``adaptive`` picks per entity: same-sign growth above 80 % monotone, deviation above 15 Gaussian, any inflection rolling,
    else a linear blend from monotone to Gaussian.
    """
    extra = ["tier"] if "tier" in df.columns else []
    if extra:
        first = F.first("tier", True).over(W.partitionBy(*roles.entity).orderBy(roles.year).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        df = df.withColumn("tier", first)
    p = paths(df, last_historical, roles, extra)
    strength = _by_tier(settings.tier_strength, settings.strength) if extra else F.lit(settings.strength)
    target = _by_tier(settings.target_growth, settings.target_growth[0]) if extra else F.lit(settings.target_growth[0])
    p = p.withColumn("_k", strength.cast("double")).withColumn("_t", target.cast("double"))
    v, y, n, h, k = (F.col(c) for c in ("_v", "_y", "_n", "_h", "_k"))
    shift = lambda a: transition(a, v, y, h, last_historical, settings)
    if settings.method == "gaussian":
        return unfold(p.withColumn("_o", shift(smooth_gaussian(v, n, h, k, settings.boundary))), {"_v": roles.value, "_o": "harmonized"}, roles)
    if settings.method == "rolling":
        return unfold(p.withColumn("_o", shift(smooth_rolling(v, n, k))), {"_v": roles.value, "_o": "harmonized"}, roles)
    p = p.withColumn("_mono", smooth_monotone(v, n, h, k))
    p = p.withColumn("_mono", converge(shift(F.col("_mono")), n, h, F.col("_t")))
    if settings.method == "monotone":
        return unfold(p, {"_v": roles.value, "_mono": "harmonized"}, roles)
    growth = F.transform(F.slice("_v", 2, F.greatest(n - 1, F.lit(0))), lambda x, i: F.when(F.get(v, i) > 0, (x / F.get(v, i) - 1) * 100).otherwise(0.0))
    p = p.withColumn("_g", growth).withColumn("_m", F.try_divide(_sum(F.col("_g")), F.size("_g").cast("double")))
    spread = F.sqrt(F.try_divide(F.aggregate("_g", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))), F.size("_g").cast("double")))
    same = F.try_divide(F.greatest(F.size(F.filter("_g", lambda x: x > 0)), F.size(F.filter("_g", lambda x: x < 0))).cast("double"), F.size("_g").cast("double"))
    bends = inflections(df, settings.sensitivity, settings.min_prominence, roles).groupBy(*roles.entity).agg(F.count(F.lit(1)).alias("_bends"))
    p = p.join(bends, roles.entity, "left")
    branch = F.when(same > 0.8, "monotone").when(spread > 15.0, "gaussian").when(F.col("_bends") > 0, "rolling").otherwise("blend")
    p = p.withColumn("branch", branch)
    soft = shift(smooth_gaussian(v, n, h, k, settings.boundary))
    blend = F.transform("_mono", lambda x, i: (0.7 - 0.4 * F.coalesce(F.try_divide(i, n - 1), F.lit(0.0))) * x + (0.3 + 0.4 * F.coalesce(F.try_divide(i, n - 1), F.lit(0.0))) * F.get(F.col("_soft"), i))
    p = p.withColumn("_soft", soft)
    chosen = (F.when(F.col("branch") == "monotone", F.col("_mono")).when(F.col("branch") == "gaussian", shift(smooth_gaussian(v, n, h, k * 1.5, settings.boundary)))
              .when(F.col("branch") == "rolling", shift(smooth_rolling(v, n, k))).otherwise(blend))
    p = p.withColumn("_c", chosen).withColumn("_o", converge(shift(F.col("_c")), n, h, F.col("_t")))
    return unfold(p, {"_v": roles.value, "_o": "harmonized"}, roles, ["branch"])


def match_world(df: DataFrame, tolerance: float = 0.001, roles: Roles = DEFAULT) -> DataFrame:
    """Entity rows scaled to the row for the whole world of their market-year where off by more than 0.1 %.

    The world row is found by name; region rows (``region_type`` = region) are neither counted nor moved.
    """
    lowered = F.lower(roles.name)
    is_world = F.exists(F.array(*[F.lit(t) for t in WORLD_TERMS]), lambda t: F.contains(lowered, t))
    region = F.coalesce(F.col("region_type") == "region", F.lit(False)) if "region_type" in df.columns else F.lit(False)
    marked = df.withColumn("_w", is_world).withColumn("_e", ~is_world & ~region)
    sums = marked.groupBy(*roles.period).agg(F.sum(F.when(F.col("_e"), F.col(roles.value))).alias("_sum"), F.max(F.when(F.col("_w"), F.col(roles.value))).alias("_world"))
    off = (F.col("_sum") > 0) & (F.abs(F.col("_sum") - F.col("_world")) / F.col("_world") > tolerance)
    side = sums.select(*roles.period, F.when(F.col("_world") > 0, F.when(off, F.col("_world") / F.col("_sum"))).alias("_f"))
    return (marked.join(calendar_side(side, roles.by), roles.period)
            .withColumn(roles.value, F.when(F.col("_e"), F.col(roles.value) * F.coalesce("_f", F.lit(1.0))).otherwise(F.col(roles.value))).select(*df.columns))


def refresh_regions(df: DataFrame, leaf_table: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Region rows replaced by the sum of their leaves; entity rows untouched."""
    entities = df.where(F.col("region_type") != "region")
    sums = sum_regions(entities, leaf_table, roles).select(*roles.period, roles.name, F.col(roles.value).alias("_s"))
    regions = df.where(F.col("region_type") == "region").join(sums, [*roles.period, roles.name], "left")
    return entities.unionByName(regions.withColumn(roles.value, F.coalesce("_s", roles.value)).select(*df.columns))
