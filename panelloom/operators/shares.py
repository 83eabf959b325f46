"""Share distribution: measure shares, project them, limit them, multiply by a total, make every year add up.

Market-year groups hold every entity, so they are only ever aggregated; windows run over one entity's history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, order, scalars as S
from panelloom.functions.session import calendar_side, cut_lineage, with_row
from panelloom.roles import (DEFAULT, DEFAULT_BOUNDS, PHASE_BOUNDS, SMOOTHING_BY_TIER, SMOOTHING_OTHER, TIER_BOUND_FACTORS,
                             DistributionSettings, Roles)

SHARE = "market_share"


def market_shares(df: DataFrame, roles: Roles = DEFAULT, zero_policy: str = "skip") -> DataFrame:
    """Share in % of each entity within its market-year.

    A market-year whose total is not positive is left out (``skip``), kept with a null share and a flag (``interpolate``), or
    kept with share 0 (``zero``).
    """
    totals = df.groupBy(*roles.period).agg(F.sum(roles.value).alias("_total"))
    joined = df.join(calendar_side(totals, roles.by), roles.period)
    usable = F.col("_total") > 0
    share = F.try_divide(F.col(roles.value), F.col("_total")) * 100
    if zero_policy == "skip":
        return joined.where(usable).withColumn(SHARE, share).drop("_total")
    if zero_policy == "zero":
        return joined.withColumn(SHARE, F.when(usable, share).otherwise(F.lit(0.0))).drop("_total")
    if zero_policy == "interpolate":
        return (joined.withColumn(SHARE, F.when(usable, share)).withColumn("needs_interpolation", ~F.coalesce(usable, F.lit(False)))
                .drop("_total"))
    raise ValueError(f"unknown zero policy {zero_policy}")


def normalize(df: DataFrame, group: list[str], value: str, target: float = 100.0, min_value: float | None = None,
              tiebreak: str = "id") -> DataFrame:
    """Scale each group to ``target``; with a floor, what the floor adds is taken from the members above it in proportion.

    Two aggregate passes over the group. A residual left by floored negatives goes to the largest member (lowest
    ``tiebreak`` among equals). A group without a positive sum is split equally among its valid members.
    """
    v = F.col(value)
    valid = v.isNotNull() & (v >= 0)
    first = df.groupBy(*group).agg(F.sum(F.when(valid, v)).alias("_sum"), F.count_if(valid).alias("_k"))
    scaled = df.join(first, group)
    usable = F.col("_sum") > 0
    out = (F.when(usable, v * (F.lit(target) / F.col("_sum")))
           .when(valid, F.lit(target) / F.col("_k")).otherwise(F.lit(0.0)))
    scaled = scaled.withColumn("_x", out).withColumn("_ok", valid)
    x = F.col("_x")
    if min_value is None:
        return scaled.drop(value, "_sum", "_k", "_ok").withColumnRenamed("_x", value).select(*df.columns)
    low = F.col("_sum").isNotNull() & (F.col("_sum") > 0) & (x < min_value)
    above = ~low & F.col("_ok")
    second = scaled.groupBy(*group).agg(
        F.count_if(low).alias("_nlow"), F.count_if(low & ~F.col("_ok")).alias("_nneg"),
        F.coalesce(F.sum(F.when(above, x)), F.lit(0.0)).alias("_above"),
        F.max_by(F.col(tiebreak), F.when(F.col("_ok"), F.struct(x, -F.col(tiebreak)))).alias("_top"))
    excess = F.lit(target) - F.col("_nlow") * min_value - F.col("_above")
    spread = x * (1 + F.try_divide(excess, F.col("_above")))
    floored = F.when(low, F.lit(min_value)).when(above & (F.col("_nlow") > 0) & (F.col("_above") > 0), spread).otherwise(x)
    residual = F.when((F.col(tiebreak) == F.col("_top")) & (F.col("_nneg") > 0), F.col("_nneg") * min_value).otherwise(F.lit(0.0))
    return (scaled.join(second, group).withColumn("_y", floored + residual)
            .drop(value).withColumnRenamed("_y", value).select(*df.columns))


def share_changes(shares: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Adds ``change``: share over the entity's previous share, 1 where that is missing or practically zero."""
    before = F.lag(SHARE).over(W.partitionBy(*roles.entity).orderBy(roles.year))
    return shares.withColumn("change", F.when(before > 1e-6, F.try_divide(F.col(SHARE), before)).otherwise(F.lit(1.0)))


def phase_of(mean: Column, deviation: Column, rows: Column) -> Column:
    return (F.when(rows < 2, "growth").when((mean > 2.0) & (deviation > 0.5), "emerging").when(mean > 1.2, "growth")
            .when((mean > 0.8) & (deviation < 0.3), "mature").otherwise("declining"))


def phases(shares: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(entity, phase) from mean and population deviation of the share ratio."""
    c = F.col("change")
    stats = share_changes(shares, roles).groupBy(*roles.entity).agg(
        F.avg(c).alias("mean_change"), F.stddev_pop(c).alias("std_change"), F.count(c).alias("_n"))
    return stats.withColumn("phase", phase_of(F.col("mean_change"), F.col("std_change"), F.col("_n"))).drop("_n")


def bound_columns(phase: Column, tier: Column | None = None) -> tuple[Column, Column]:
    """Lowest and highest valid share multiplier of a phase, stretched by tier where one is given."""
    low = high = None
    for name, (a, b) in PHASE_BOUNDS.items():
        low = F.when(phase == name, a) if low is None else low.when(phase == name, a)
        high = F.when(phase == name, b) if high is None else high.when(phase == name, b)
    low, high = low.otherwise(DEFAULT_BOUNDS[0]), high.otherwise(DEFAULT_BOUNDS[1])
    if tier is not None:
        fa = fb = None
        for t, (a, b) in TIER_BOUND_FACTORS.items():
            fa = F.when(tier == t, a) if fa is None else fa.when(tier == t, a)
            fb = F.when(tier == t, b) if fb is None else fb.when(tier == t, b)
        low, high = low * fa.otherwise(1.0), high * fb.otherwise(1.0)
    return low, high


def share_trends(shares: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(entity, trend_factor): recent-weighted mean share ratio inside the phase bounds, half of its move kept, in [0.8, 1.3]."""
    whole = W.partitionBy(*roles.entity)
    c = F.col("change")
    rows = (share_changes(shares, roles).withColumn("_n", F.count(c).over(whole))
            .withColumn("_phase", phase_of(F.avg(c).over(whole), F.stddev_pop(c).over(whole), F.col("_n"))))
    low, high = bound_columns(F.col("_phase"))
    valid = (c > low) & (c < high)
    from_end = F.sum(valid.cast("int")).over(whole.orderBy(roles.year).rowsBetween(0, W.unboundedFollowing))
    weight = 0.5 + 0.5 * F.try_divide((F.col("_n") - F.col("_j")).cast("double"), (F.col("_n") - 1).cast("double"))
    rows = rows.withColumn("_ok", valid).withColumn("_j", from_end).withColumn("_w", F.when(F.col("_ok"), weight))
    mean = F.try_divide(F.sum(F.col("_w") * c), F.sum("_w"))
    kept = 1 + (F.col("_mean") - 1) * 0.5
    return (rows.groupBy(*roles.entity).agg(F.max("_n").alias("_n"), mean.alias("_mean"))
            .select(*roles.entity, F.when((F.col("_n") < 2) | F.col("_mean").isNull(), F.lit(1.0))
                    .otherwise(S.clip(kept, 0.8, 1.3)).alias("trend_factor")))


def tier_of(share: Column | str, thresholds: tuple[float, ...]) -> Column:
    """Tier from 1: the first threshold not above the share; one more than their number below all of them."""
    share = S.col(share)
    ordered = sorted(thresholds, reverse=True)
    out = F.when(share >= ordered[0], 1)
    for i, t in enumerate(ordered[1:], start=2):
        out = out.when(share >= t, i)
    return out.otherwise(len(ordered) + 1)


def tier_change_cap(tier: Column, ahead: Column, caps: tuple[float, ...] = (0.2, 0.3, 0.5)) -> Column:
    base = reduce(lambda acc, it: acc.when(tier == it[0], it[1]), list(enumerate(caps[:-1], start=1))[1:],
                  F.when(tier == 1, caps[0])).otherwise(caps[-1])
    return F.least(base * (1 + 0.2 * (ahead - 1)), F.lit(1.0))


def project_shares(shares: DataFrame, horizon: int, settings: DistributionSettings = DistributionSettings(),
                   roles: Roles = DEFAULT, trends: DataFrame | None = None) -> DataFrame:
    """Latest shares carried ``horizon`` years ahead by their damped trend, rescaled to 100 per market-year."""
    trends = share_trends(shares, roles) if trends is None else trends
    last = shares.groupBy(*roles.by).agg(F.max(roles.year).alias(roles.year))
    base = shares.join(last if roles.by else F.broadcast(last), roles.period, "left_semi").join(trends, roles.entity, "left")
    ahead = F.col("_h").cast("double")
    damp = 2.0 / (1 + F.exp(0.3 * ahead)) - 0.5
    if settings.damping_floor is not None:
        damp = F.greatest(damp, F.lit(settings.damping_floor))
    steps = (base.withColumn("tier", tier_of(SHARE, settings.tier_thresholds))
             .withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))
    cap = tier_change_cap(F.col("tier"), ahead, settings.tier_change_caps)
    moved = F.col(SHARE) * S.clip(F.pow(F.coalesce("trend_factor", F.lit(1.0)), damp * ahead), 1 - cap, 1 + cap)
    moved = F.coalesce(F.greatest(moved, F.lit(0.0)), F.lit(0.0))
    projected = steps.select(*roles.entity, roles.name, (F.col(roles.year) + F.col("_h")).alias(roles.year), "tier",
                             moved.alias(SHARE))
    return rescale_shares(projected, roles)


def rescale_shares(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Shares to 100 per market-year; equal split where their sum is not usable."""
    sums = df.groupBy(*roles.period).agg(F.sum(SHARE).alias("_sum"), F.count(F.lit(1)).alias("_k"))
    even = F.lit(100.0) / F.col("_k")
    return (df.join(calendar_side(sums, roles.by), roles.period)
            .withColumn(SHARE, F.when(F.col("_sum") > 0, F.col(SHARE) / F.col("_sum") * 100).otherwise(even))
            .select(*df.columns))


def growth_limits(shares: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(market…, max_growth_rate, min_growth_rate): 1.5 times the outer deciles of yearly share growth, kept in 40..100 and -50..-20."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    growth = F.when(F.lag(roles.year).over(w) == F.col(roles.year) - 1,
                    (F.try_divide(F.col(SHARE), F.lag(SHARE).over(w)) - 1) * 100)
    rows = shares.select(*roles.entity, growth.alias("_g"))
    tails = order.quantiles(rows, list(roles.by), "_g", {"_q10": 0.1, "_q90": 0.9})
    return tails.select(*roles.by, S.clip(F.col("_q90") * 1.5, 40.0, 100.0).alias("max_growth_rate"),
                        S.clip(F.col("_q10") * 1.5, -50.0, -20.0).alias("min_growth_rate"))


def limit_growth(projected: DataFrame, shares: DataFrame, horizon: int, limits: DataFrame,
                 settings: DistributionSettings = DistributionSettings(), roles: Roles = DEFAULT) -> DataFrame:
    """Hold each year's share growth to the limits against the year before *after* its own limit and rescale.

    Every market steps on from its own last year. Years depend on each other across entities, so this is a driver loop over the horizon; each step is a keyed join and
    two aggregates, and its result is cut off from its lineage so that neither the plan nor a recovery grows with the years.
    """
    last = shares.groupBy(*roles.by).agg(F.max(roles.year).alias(roles.year))
    before = (shares.join(last if roles.by else F.broadcast(last), roles.period, "left_semi")
              .select(*roles.entity, F.col(SHARE).alias("_prev")))
    ends = last.withColumnRenamed(roles.year, "_last")
    stepped = projected.join(ends, list(roles.by)) if roles.by else projected.transform(with_row, ends)
    stepped, limits = cut_lineage(stepped.withColumn("_step", F.col(roles.year) - F.col("_last"))), cut_lineage(limits)
    done = []
    for step in range(1, horizon + 1):
        rows = stepped.where(F.col("_step") == step).join(before, roles.entity, "left")
        rows = rows.join(limits, list(roles.by), "left") if roles.by else rows.transform(with_row, limits, "left")
        rows = rows.withColumn("_prev", F.when(F.col("_prev") > 0, F.col("_prev")).otherwise(F.lit(0.01)))
        size = (F.when(F.col("_prev") < 1.0, 2.0).when(F.col("_prev") < 5.0, 1.5).otherwise(1.0)
                if settings.scale_limits_by_size else F.lit(1.0))
        top = F.coalesce("max_growth_rate", F.lit(60.0)) * size
        low = F.coalesce("min_growth_rate", F.lit(-30.0)) * size
        growth = S.growth_rate(SHARE, "_prev", high=200.0, low=-90.0)
        held = (F.when(growth > top, F.col("_prev") * (1 + top / 100)).when(growth < low, F.col("_prev") * (1 + low / 100))
                .otherwise(F.col(SHARE)))
        rows = rows.withColumn(SHARE, held).select(*projected.columns)
        rows = normalize(rows, roles.period, SHARE, 100.0, settings.min_market_share, roles.id)
        rows = cut_lineage(rows)
        done.append(rows)
        before = rows.select(*roles.entity, F.col(SHARE).alias("_prev"))
    return reduce(DataFrame.unionByName, done)


def carry_missing_years(shares: DataFrame, world: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Shares plus, for every year of the total series without entity rows, a copy of the latest shares."""
    held = shares.select(*roles.period).distinct()
    absent = world.select(*roles.period).distinct().join(held, roles.period, "left_anti").withColumnRenamed(roles.year, "_y")
    last = shares.groupBy(*roles.by).agg(F.max(roles.year).alias(roles.year))
    latest = shares.join(last if roles.by else F.broadcast(last), roles.period, "left_semi").drop(roles.year)
    filled = latest.join(absent, list(roles.by)) if roles.by else latest.transform(with_row, absent)
    return shares.unionByName(filled.withColumnRenamed("_y", roles.year).select(*shares.columns))


def distribute_values(shares: DataFrame, world: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """value = share of the total, with shares first brought to 100 so that every market-year adds up to its total.

    A market-year that the total series lacks stays, with a null value; ``fill_total_series`` gives it one beforehand.
    """
    sums = shares.groupBy(*roles.period).agg(F.sum(SHARE).alias("_sum"))
    side = sums.join(world.select(*roles.period, F.col(roles.value).alias("_world")), roles.period, "left")
    joined = shares.drop(roles.value).join(calendar_side(side, roles.by), roles.period)
    off = (F.abs(F.col("_sum") - 100) > 0.01) & (F.col("_sum") > 0)
    return (joined.withColumn(SHARE, F.when(off, F.col(SHARE) / F.col("_sum") * 100).otherwise(F.col(SHARE)))
            .withColumn(roles.value, F.col(SHARE) * F.col("_world") / 100).drop("_sum", "_world"))


def fill_total_series(world: DataFrame, years: DataFrame, max_gap: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    """The total series at every requested year, with the rule that produced each value.

    Inside a gap of at most ``max_gap`` years on each side: linear. With two known years on one side only: their trend. Else
    the nearest known value.
    """
    y, v = roles.year, roles.value
    w = W.partitionBy(*roles.by).orderBy(y)
    known = (world.where(F.col(v).isNotNull())
             .select(*roles.period, F.struct(F.col(y).alias("y"), F.col(v).alias("v"), F.lag(y).over(w).alias("py"),
                                             F.lag(v).over(w).alias("pv"), F.lead(y).over(w).alias("ny"),
                                             F.lead(v).over(w).alias("nv")).alias("_k")))
    spine = years.select(*roles.period).unionByName(known.select(*roles.period)).distinct().join(known, roles.period, "left")
    spine = (spine.withColumn("_b", F.last("_k", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
             .withColumn("_a", F.first("_k", True).over(w.rowsBetween(1, W.unboundedFollowing))))
    year = F.col(y)

    def near(at):
        return F.coalesce(F.abs(year - at) <= max_gap, F.lit(False))

    any_near = near(F.col("_b.y")) | near(F.col("_a.y"))
    b1 = F.col("_b").isNotNull() & (~any_near | near(F.col("_b.y")))
    b2 = b1 & F.col("_b.py").isNotNull() & (~any_near | near(F.col("_b.py")))
    a1 = F.col("_a").isNotNull() & (~any_near | near(F.col("_a.y")))
    a2 = a1 & F.col("_a.ny").isNotNull() & (~any_near | near(F.col("_a.ny")))
    linear = F.col("_b.v") + (year - F.col("_b.y")) / (F.col("_a.y") - F.col("_b.y")) * (F.col("_a.v") - F.col("_b.v"))
    ahead = F.col("_b.v") + (F.col("_b.v") - F.col("_b.pv")) / (F.col("_b.y") - F.col("_b.py")) * (year - F.col("_b.y"))
    back = F.col("_a.v") - (F.col("_a.nv") - F.col("_a.v")) / (F.col("_a.ny") - F.col("_a.y")) * (F.col("_a.y") - year)
    value = (F.when(F.col("_k").isNotNull(), F.col("_k.v")).when(b1 & a1, linear).when(b2, ahead).when(a2, back)
             .when(b1, F.col("_b.v")).when(a1, F.col("_a.v")))
    rule = (F.when(F.col("_k").isNotNull(), "known").when(b1 & a1, "linear").when(b2, "trend").when(a2, "reverse_trend")
            .when(b1 | a1, "nearest"))
    return spine.select(*roles.period, value.alias(v), rule.alias("rule"))


def mean_growth_fill(world: DataFrame, years: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Fallback for years outside the known span: nearest known value compounded by the mean yearly growth."""
    y, v = roles.year, roles.value
    w = W.partitionBy(*roles.by).orderBy(y)
    growth = F.when(F.lag(v).over(w) > 0, F.try_divide(F.col(v), F.lag(v).over(w)) - 1)
    stats = world.withColumn("_g", growth).groupBy(*roles.by).agg(
        F.avg("_g").alias("_g"), F.min_by(v, y).alias("_fv"), F.min(y).alias("_fy"), F.max_by(v, y).alias("_lv"), F.max(y).alias("_ly"))
    wanted = years.select(*roles.period).join(world.select(*roles.period), roles.period, "left_anti")
    joined = wanted.join(stats, list(roles.by)) if roles.by else wanted.transform(with_row, stats)
    late = F.col(y) > F.col("_ly")
    return (joined.where((F.col(y) < F.col("_fy")) | late)
            .select(*roles.period, (F.when(late, F.col("_lv")).otherwise(F.col("_fv"))
                                    * F.pow(1 + F.col("_g"), F.col(y) - F.when(late, F.col("_ly")).otherwise(F.col("_fy")))).alias(v)))


def _tier_pick(tier: Column, index: int) -> Column:
    out = None
    for t, p in SMOOTHING_BY_TIER.items():
        out = F.when(tier == t, p[index]) if out is None else out.when(tier == t, p[index])
    return out.otherwise(SMOOTHING_OTHER[index])


def smooth_values(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Replace growth by its clipped, centred-mean, exponentially weighted form pulled to a long-run rate, compound it back, and
    keep each market-year's total. Entities with fewer than three years, and markets of at most three, keep their path."""
    y, v = roles.year, roles.value
    w = W.partitionBy(*roles.entity).orderBy(y)
    all_rows = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = df.withColumn("_tier", F.first("tier", True).over(all_rows)).withColumn("_n", F.count(F.lit(1)).over(all_rows))
    growth = S.clip((F.try_divide(F.col(v), F.lag(v).over(w)) - 1) * 100, -40.0, 80.0)
    rows = rows.withColumn("_g", growth)
    three, five, four = (F.avg("_g").over(w.rowsBetween(a, b)) for a, b in ((-1, 1), (-2, 2), (-2, 1)))
    tier = F.col("_tier")
    rows = rows.withColumn("_s", F.when(tier.isin(1, 2), three).when(tier == 3, five).otherwise(four))
    rows = rows.withColumn("_s", F.coalesce(F.first("_s", True).over(w.rowsBetween(0, W.unboundedFollowing)),
                                            F.last("_s", True).over(w.rowsBetween(W.unboundedPreceding, 0))))
    low, high, goal = _tier_pick(tier, 2), _tier_pick(tier, 1), _tier_pick(tier, 3)
    rows = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_goal", goal)
    none = F.lit(None).cast("double")

    def step(s: Column, x: Column) -> dict[str, Column]:
        ewm = F.when(s["n"] == 0, x["_s"]).otherwise(0.5 * x["_s"] + 0.5 * s["ewm"])
        first = F.when(s["n"] == 0, x[y]).otherwise(s["first"])
        weight = F.least(F.lit(0.9), 0.25 * (x[y] - first))
        rate = (1 - weight) * F.least(F.greatest(ewm, x["_low"]), x["_high"]) + weight * x["_goal"]
        value = F.when(s["n"] == 0, x[v]).otherwise(s["value"] * (1 + F.coalesce(rate, F.lit(0.0)) / 100))
        return {"n": s["n"] + 1, "first": first, "ewm": ewm, "value": value}

    folded = folds.scan_rows(rows, roles.entity, y, {"n": F.lit(0), "first": F.lit(0), "ewm": none, "value": none}, step,
                             lambda s, x: {"_v": s["value"]}, "_v double")
    folded = folded.withColumn("_v", F.when(F.col("_n") >= 3, F.col("_v")).otherwise(F.col(v)))
    sums = folded.groupBy(*roles.period).agg(F.sum(v).alias("_was"), F.sum("_v").alias("_is"))
    # One row per market-year: counting them gives the years of the market.
    sums = sums.withColumn("_long", F.count(F.lit(1)).over(W.partitionBy(*roles.by)) > 3)
    factor = F.when((F.col("_is") > 0) & (F.col("_was") > 0), F.col("_was") / F.col("_is")).when(F.col("_was") == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    final = (folded.join(calendar_side(sums, roles.by), roles.period)
             .withColumn(v, F.when(F.col("_long"), F.col("_v") * factor).otherwise(F.col(v))))
    final = final.withColumn(SHARE, F.when(F.col("_was") > 0, F.col(v) / F.col("_was") * 100).otherwise(F.col(SHARE)))
    return final.select(*df.columns)


def splice(kept: DataFrame, recomputed: DataFrame, start_year: int, roles: Roles = DEFAULT) -> DataFrame:
    """Rows before ``start_year`` from ``kept``, the rest from ``recomputed``; a repeated entity-year keeps the recomputed row."""
    both = (kept.where(F.col(roles.year) < start_year).withColumn("_late", F.lit(0))
            .unionByName(recomputed.withColumn("_late", F.lit(1)), allowMissingColumns=True))
    w = W.partitionBy(*roles.entity, roles.year).orderBy(F.desc("_late"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_late")


def rescale_to_total(df: DataFrame, world: DataFrame, tolerance: float = 0.001, roles: Roles = DEFAULT) -> DataFrame:
    """Entity rows scaled to the total of their market-year where they are off by more than the tolerance."""
    sums = df.groupBy(*roles.period).agg(F.sum(roles.value).alias("_sum"))
    side = sums.join(world.select(*roles.period, F.col(roles.value).alias("_world")), roles.period)
    factor = F.when((F.col("_sum") > 0) & (F.abs(F.col("_sum") - F.col("_world")) > tolerance), F.col("_world") / F.col("_sum")).otherwise(F.lit(1.0))
    side = side.select(*roles.period, factor.alias("_f"))
    return (df.join(calendar_side(side, roles.by), roles.period, "left")
            .withColumn(roles.value, F.col(roles.value) * F.coalesce("_f", F.lit(1.0))).drop("_f"))


def distribute(history: DataFrame, world: DataFrame, horizon: int,
               settings: DistributionSettings = DistributionSettings(), roles: Roles = DEFAULT,
               adjust=None, regions: DataFrame | None = None) -> DataFrame:
    """The whole work: shares, tiers, projection, optional share adjustment, limits, values, smoothing, totals, regions.

    ``world`` holds the totals; years that it lacks are filled in (``fill_total_series``), and a historical year of it without entity rows
    takes the latest shares. Every market is carried ``horizon`` years on from its own last year. ``adjust`` maps shares to adjusted shares.
    ``regions`` is a closure table (region, leaf); region rows are computed last from the final entity rows and carry
    ``region_type = 'region'``.
    """
    shares = market_shares(history, roles, settings.zero_policy)
    ends = history.groupBy(*roles.by).agg(F.max(roles.year).alias("_last"))
    past = world.join(ends, list(roles.by)) if roles.by else world.transform(with_row, ends)
    shares = carry_missing_years(shares, past.where(F.col(roles.year) <= F.col("_last")), roles)
    # The raw rows are read once: everything below works on one row per entity-year.
    shares = cut_lineage(shares.withColumn("tier", tier_of(SHARE, settings.tier_thresholds)))
    projected = project_shares(shares.drop("tier"), horizon, settings, roles)
    if adjust is not None:
        projected = rescale_shares(adjust(projected), roles)
    if settings.max_growth_rate is not None and settings.min_growth_rate is not None:
        limits = shares.select(*roles.by).distinct().select(
            *roles.by, F.lit(settings.max_growth_rate).alias("max_growth_rate"), F.lit(settings.min_growth_rate).alias("min_growth_rate"))
    else:
        limits = growth_limits(shares, roles)
    limited = limit_growth(projected, shares, horizon, limits, settings, roles)
    columns = [*roles.entity, roles.name, roles.year, SHARE, "tier"]
    both = shares.select(*columns).unionByName(limited.select(*columns))
    world = cut_lineage(fill_total_series(world, both.select(*roles.period).distinct(), roles=roles).drop("rule"))
    values = distribute_values(both, world, roles)
    if settings.start_year is not None:
        kept = shares.select(*columns, roles.value)
        values = splice(kept, values.where(F.col(roles.year) >= settings.start_year).select(*columns, roles.value), settings.start_year, roles)
    if settings.smooth:
        # Smoothing and the rescale below each read their input twice (rows and totals): both start from written rows.
        values = smooth_values(cut_lineage(values.select(*columns, roles.value)), roles)
    values = rescale_to_total(cut_lineage(values.select(*columns, roles.value)), world, settings.tolerance, roles)
    values = values.withColumn("region_type", F.lit("entity"))
    if regions is None:
        return values
    from panelloom.operators.regions import sum_regions
    return values.unionByName(sum_regions(values, regions, roles), allowMissingColumns=True)
