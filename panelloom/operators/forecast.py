"""Forecasters over many keyed series at once.

Contract: a forecaster maps ``series(key, date, value)`` to a long table ``(key, date, model, horizon, value, lower, upper)``.
Fits are aggregates or folds per key, so all keys are fitted in one job. ``frequency`` is Y, Q or M.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions.session import with_row
from panelloom.functions import folds, scalars as S
from panelloom.roles import DEFAULT, Roles

MONTHS = {"Y": 12, "Q": 3, "M": 1}
Z95 = 1.96


def extend_total(world: DataFrame, horizon: int, last_n: int | None = None, rate: float | None = None, roles: Roles = DEFAULT) -> DataFrame:
    """The yearly total series carried on by its compound growth over all or the last ``last_n`` years, or at a fixed rate."""
    y, v = roles.year, roles.value
    base = world
    if last_n is not None:
        end = world.groupBy(*roles.by).agg(F.max(y).alias("_end"))
        base = (world.join(end, list(roles.by)) if roles.by else world.transform(with_row, end)).where(F.col(y) >= F.col("_end") - last_n)
    fit = base.groupBy(*roles.by).agg(F.min_by(v, y).alias("_a"), F.max_by(v, y).alias("_b"), F.min(y).alias("_ya"), F.max(y).alias("_yb"))
    growth = F.lit(rate) if rate is not None else S.cagr_fraction("_a", "_b", (F.col("_yb") - F.col("_ya")).cast("double"))
    ahead = (fit.withColumn("_g", F.coalesce(growth, F.lit(0.0))).withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
             .select(*roles.by, (F.col("_yb") + F.col("_h")).alias(y), (F.col("_b") * F.pow(1 + F.col("_g"), F.col("_h"))).alias(v)))
    return world.select(*roles.by, y, v).unionByName(ahead)


def indexed(series: DataFrame) -> DataFrame:
    """Adds ``t``: position in the series from 0."""
    return series.withColumn("t", (F.row_number().over(W.partitionBy("key").orderBy("date")) - 1).cast("double"))


def ahead(fit: DataFrame, horizon: int, frequency: str) -> DataFrame:
    """One row per key and step, dated from ``last_date``."""
    steps = fit.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("date", F.add_months("last_date", F.col("horizon") * MONTHS[frequency]))


def long_form(df: DataFrame, model: str, value: Column, margin: Column, floor: float | None = 0.0) -> DataFrame:
    def kept(c: Column) -> Column:
        return c if floor is None else F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))
    return df.select("key", "date", F.lit(model).alias("model"), "horizon", kept(value).alias("value"), kept(value - margin).alias("lower"), (value + margin).alias("upper"))


# ---- compound growth ----------------------------------------------------------------------------------------------------

def fit_cagr(series: DataFrame, last_years: int | None = None) -> DataFrame:
    """(key, last_date, last_value, cagr in %): growth between the first and last point of the window, years of 365.25 days.

    Where it is undefined the median annualised step growth takes its place, then 0.
    """
    if last_years is not None:
        end = F.max("date").over(W.partitionBy("key"))
        series = series.withColumn("_end", end).where(F.col("date") >= F.add_months("_end", -12 * last_years)).drop("_end")
    w = W.partitionBy("key").orderBy("date")
    steps = series.withColumn("_g", F.when(F.lag("value").over(w) != 0, S.growth_rate("value", F.lag("value").over(w))))
    fit = steps.groupBy("key").agg(F.min_by("value", "date").alias("a"), F.max_by("value", "date").alias("last_value"), F.min("date").alias("d0"),
                                   F.max("date").alias("last_date"), F.percentile("_g", F.lit(0.5)).alias("step"))
    years = F.date_diff("last_date", "d0") / 365.25
    return fit.select("key", "last_date", "last_value", F.coalesce(F.when(years >= 0.1, S.cagr_percent("a", "last_value", years)), "step", F.lit(0.0)).alias("cagr"))


def cagr(series: DataFrame, horizon: int, frequency: str = "M", last_years: int | None = None, fixed_rate: float | None = None) -> DataFrame:
    fit = fit_cagr(series, last_years)
    rate = F.lit(fixed_rate) if fixed_rate is not None else F.col("cagr")
    value = F.col("last_value") * F.pow(1 + rate / 100, F.col("horizon") * (MONTHS[frequency] / 12))
    return long_form(ahead(fit, horizon, frequency), "cagr", value, F.abs(value) * 0.1)


# ---- moving average -------------------------------------------------------------------------------------------------------

def moving_average(series: DataFrame, horizon: int, frequency: str = "M", window: int = 6, weighted: bool = False) -> DataFrame:
    """Recursive: each step averages the last ``window`` values, forecasts included. Band: 1.96 deviations of the last window."""
    w = W.partitionBy("key").orderBy(F.desc("date"))
    tail = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window)
    fit = tail.groupBy("key").agg(F.max("date").alias("last_date"), F.stddev_pop("value").alias("_s"),
                                  F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda x: x["value"]).alias("_w"))

    def mean(values: Column) -> Column:
        size = F.size(values)
        if not weighted:
            return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / size
        total = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        return total / (size * (size + 1) / 2)

    # The array grows by one forecast per step; each step looks at its last ``size`` entries.
    def step(acc: Column, _: Column) -> Column:
        return F.concat(acc, F.array(mean(F.slice(acc, F.size(acc) - F.col("_k") + 1, F.col("_k")))))

    grown = fit.withColumn("_k", F.size("_w")).withColumn("_all", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_w"), step))
    rows = ahead(grown, horizon, frequency).withColumn("_v", F.element_at("_all", F.col("_k") + F.col("horizon")))
    return long_form(rows, "weighted_average" if weighted else "moving_average", F.col("_v"), Z95 * F.col("_s"))


# ---- exponential smoothing ---------------------------------------------------------------------------------------------

def smoothing_state(series: DataFrame, kind: str, alpha: float, beta: float, gamma: float, phi: float, season: int, multiplicative: bool) -> DataFrame:
    """Final level, trend and season of each key, with the sum of squared one-step errors, by one fold."""
    rows = (folds.ordered_rows(series, ["key"], "date", ["value"])
            .withColumn("last_date", F.element_at("_rows", -1)["date"]).withColumn("n", F.size("_rows")))
    v = lambda i: F.get(F.col("_rows"), F.lit(i))["value"]
    zero = F.lit(0.0)
    if kind == "triple":
        rows = rows.where(F.col("n") >= 2 * season)
        mean = lambda a: F.aggregate(F.slice("_rows", a + 1, season), zero, lambda s, x: s + x["value"]) / season
        level, trend = mean(0), (mean(season) - mean(0)) / season
        init = {"level": level, "trend": trend, "seasons": F.transform(F.slice("_rows", 1, season), lambda x: x["value"] - level), "sse": zero}
        rest = F.slice("_rows", season + 1, F.greatest(F.col("n") - season, F.lit(0)))
    else:
        start = (F.try_divide(v(1), v(0)) if multiplicative else v(1) - v(0)) if kind == "double" else zero
        rows = rows.where(F.col("n") >= 2)
        init = {"level": v(0), "trend": F.coalesce(start, F.lit(1.0 if multiplicative else 0.0)), "seasons": F.array(zero), "sse": zero}
        rest = F.slice("_rows", 2, F.greatest(F.col("n") - 1, F.lit(0)))

    def step(s: Column, x: Column) -> dict[str, Column]:
        y = x["value"]
        if kind == "simple":
            return {"level": alpha * y + (1 - alpha) * s["level"], "trend": s["trend"], "seasons": s["seasons"], "sse": s["sse"] + (y - s["level"]) * (y - s["level"])}
        if kind == "double" and multiplicative:
            guess = s["level"] * F.pow(s["trend"], F.lit(phi))
            level = alpha * y + (1 - alpha) * guess
            trend = beta * F.coalesce(F.try_divide(level, s["level"]), F.lit(1.0)) + (1 - beta) * F.pow(s["trend"], F.lit(phi))
            return {"level": level, "trend": trend, "seasons": s["seasons"], "sse": s["sse"] + (y - guess) * (y - guess)}
        old = F.element_at(s["seasons"], 1) if kind == "triple" else zero
        guess = s["level"] + phi * s["trend"] + old
        level = alpha * (y - old) + (1 - alpha) * (s["level"] + phi * s["trend"])
        trend = beta * (level - s["level"]) + (1 - beta) * phi * s["trend"]
        # The season array is a ring: its head is the season of the next row.
        seasons = (F.concat(F.slice(s["seasons"], 2, season - 1), F.array(gamma * (y - level) + (1 - gamma) * old)) if kind == "triple" else s["seasons"])
        return {"level": level, "trend": trend, "seasons": seasons, "sse": s["sse"] + (y - guess) * (y - guess)}

    final = folds.fold(rest, init, step, lambda s: s)
    return rows.select("key", "last_date", "n", final.alias("_f")).select("key", "last_date", "n", "_f.*")


def exponential_smoothing(series: DataFrame, horizon: int, frequency: str = "M", kind: str = "simple", alpha: float = 0.3, beta: float = 0.1,
                          gamma: float = 0.1, phi: float = 1.0, season: int = 12, multiplicative: bool = False) -> DataFrame:
    """Simple, double (damped by ``phi``, additive or multiplicative trend) or triple (additive season, textbook start values)."""
    fit = smoothing_state(series, kind, alpha, beta, gamma, phi, season, multiplicative)
    h = F.col("horizon")
    damp = h.cast("double") if phi == 1.0 else phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi)
    level = F.col("level")
    if kind == "simple":
        value = level
    elif kind == "double" and multiplicative:
        value = level * F.pow("trend", damp)
    else:
        value = level + damp * F.col("trend")
    if kind == "triple":
        value = value + F.element_at("seasons", (F.pmod(h - 1, F.lit(season)) + 1).cast("int"))
    spread = F.sqrt(F.try_divide(F.col("sse"), F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))) * F.sqrt(h.cast("double"))
    return long_form(ahead(fit, horizon, frequency), f"smoothing_{kind}", value, Z95 * spread)


# ---- regression and growth lines --------------------------------------------------------------------------------------

def plane(y: Column, a: Column, b: Column) -> dict[str, Column]:
    """Least squares of y on two regressors from moments: aggregate columns for intercept, first and second slope."""
    ok = y.isNotNull() & a.isNotNull() & b.isNotNull()
    y, a, b = (F.when(ok, c) for c in (y, a, b))
    va, vb, ab, ya, yb = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b), F.covar_pop(y, a), F.covar_pop(y, b)
    det = va * vb - ab * ab
    first, second = F.try_divide(ya * vb - yb * ab, det), F.try_divide(yb * va - ya * ab, det)
    return {"intercept": F.avg(y) - first * F.avg(a) - second * F.avg(b), "first": first, "second": second}


def trend_lines(series: DataFrame) -> DataFrame:
    """Linear, exponential and quadratic fit per key over the position in the series, with the residual deviation of the line."""
    t, v = F.col("t"), F.col("value")
    log = F.when(v > 0, F.log(v))
    quad = plane(v, t, t * t)
    return indexed(series).groupBy("key").agg(
        F.max("date").alias("last_date"), F.count(F.lit(1)).cast("double").alias("n"), F.regr_slope(v, t).alias("slope"), F.regr_intercept(v, t).alias("intercept"),
        F.regr_slope(log, F.when(v > 0, t)).alias("rate"), F.regr_intercept(log, F.when(v > 0, t)).alias("log_level"),
        quad["intercept"].alias("q0"), quad["first"].alias("q1"), quad["second"].alias("q2"),
        F.sqrt(F.greatest(F.var_pop(v) * (1 - F.coalesce(F.regr_r2(v, t), F.lit(0.0))), F.lit(0.0))).alias("resid"))


def _line(series, horizon, frequency, model, value):
    rows = ahead(trend_lines(series), horizon, frequency).withColumn("_t", F.col("n") - 1 + F.col("horizon"))
    return long_form(rows, model, value(F.col("_t")), S.z_value(0.95) * F.col("resid") * F.sqrt(F.col("horizon").cast("double")))


def linear(series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    return _line(series, horizon, frequency, "linear", lambda t: F.col("intercept") + F.col("slope") * t)


def exponential(series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    return _line(series, horizon, frequency, "exponential", lambda t: F.exp(F.col("log_level") + F.col("rate") * t))


def quadratic(series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    return _line(series, horizon, frequency, "quadratic", lambda t: F.col("q0") + F.col("q1") * t + F.col("q2") * t * t)


def conservative(series: DataFrame, horizon: int, frequency: str = "M", share: float = 0.7) -> DataFrame:
    """Compound growth with only a part of the measured rate."""
    fit = fit_cagr(series)
    value = F.col("last_value") * F.pow(1 + F.col("cagr") * share / 100, F.col("horizon") * (MONTHS[frequency] / 12))
    return long_form(ahead(fit, horizon, frequency), "conservative", value, F.abs(value) * 0.1)


def naive(series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    w = W.partitionBy("key").orderBy("date")
    steps = series.withColumn("_d", F.col("value") - F.lag("value").over(w))
    fit = steps.groupBy("key").agg(F.max("date").alias("last_date"), F.max_by("value", "date").alias("last_value"), F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("_s"))
    return long_form(ahead(fit, horizon, frequency), "naive", F.col("last_value"), Z95 * F.col("_s") * F.sqrt(F.col("horizon").cast("double")))


# ---- autoregression ---------------------------------------------------------------------------------------------------

def difference(series: DataFrame, lag: int = 1, times: int = 1) -> DataFrame:
    """Adds ``diff``: the series differenced ``times`` times at ``lag``; null at the start."""
    w = W.partitionBy("key").orderBy("date")
    out = series.withColumn("diff", F.col("value"))
    for _ in range(times):
        out = out.withColumn("diff", F.col("diff") - F.lag("diff", lag).over(w))
    return out


def autocorrelation(series: DataFrame, lags: int = 12, times: int = 1) -> DataFrame:
    """(key, lag, acf): one window pass gives all lags, unpivoted afterwards."""
    w = W.partitionBy("key").orderBy("date")
    d = difference(series, 1, times).where(F.col("diff").isNotNull())
    d = d.withColumn("_c", F.col("diff") - F.avg("diff").over(W.partitionBy("key")))
    d = d.select("key", "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = d.groupBy("key").agg(*[F.try_divide(F.sum(F.col("_c") * F.col(f"_l{k}")), F.sum(F.col("_c") * F.col("_c"))).alias(str(k)) for k in range(1, lags + 1)])
    return sums.unpivot(["key"], [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def autoregressive(series: DataFrame, horizon: int, frequency: str = "M", season: int | None = None) -> DataFrame:
    """AR(1) with drift on the first difference, or on the seasonal difference when ``season`` is given."""
    lag = season or 1
    w = W.partitionBy("key").orderBy("date")
    d = difference(series, lag).withColumn("_p", F.lag("diff").over(w))
    both = F.col("diff").isNotNull() & F.col("_p").isNotNull()
    y, x = F.when(both, F.col("diff")), F.when(both, F.col("_p"))
    ranked = d.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("date"))))
    fit = ranked.groupBy("key").agg(
        F.max("date").alias("last_date"), F.max_by("diff", "date").alias("_d"), F.regr_slope(y, x).alias("phi"), F.regr_intercept(y, x).alias("drift"),
        F.sqrt(F.greatest(F.var_pop(y) * (1 - F.coalesce(F.regr_r2(y, x), F.lit(0.0))), F.lit(0.0))).alias("_s"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= lag, F.struct("date", "value")))), lambda s: s["value"]).alias("_tail"))
    fit = fit.where(F.col("phi").isNotNull() & (F.size("_tail") == lag))

    def step(acc: Column, _: Column) -> Column:
        change = F.col("drift") + F.col("phi") * acc["d"]
        return F.struct(change.alias("d"), F.concat(acc["path"], F.array(F.element_at(acc["path"], -lag) + change)).alias("path"))

    start = F.struct(F.col("_d").alias("d"), F.col("_tail").alias("path"))
    grown = fit.withColumn("_path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda a: a["path"]))
    rows = ahead(grown, horizon, frequency).withColumn("_v", F.element_at("_path", F.lit(lag) + F.col("horizon")))
    name = "autoregressive" if season is None else "seasonal_autoregressive"
    return long_form(rows, name, F.col("_v"), Z95 * F.col("_s") * F.sqrt(F.col("horizon").cast("double")), None)


def seasonal_naive(series: DataFrame, horizon: int, frequency: str = "M", season: int = 12) -> DataFrame:
    """The value one season (or as many as needed) back, matched by date."""
    fit = series.groupBy("key").agg(F.max("date").alias("last_date"), F.stddev_pop("value").alias("_s"))
    months = MONTHS[frequency] * season
    rows = ahead(fit, horizon, frequency).withColumn("_back", F.ceil(F.col("horizon") / season).cast("int"))
    rows = rows.withColumn("_src", F.add_months("date", -months * F.col("_back")))
    past = series.select("key", F.col("date").alias("_src"), F.col("value").alias("_v"))
    return long_form(rows.join(past, ["key", "_src"]), "seasonal_naive", F.col("_v"), Z95 * F.col("_s"))


# ---- diffusion curves -----------------------------------------------------------------------------------------------------

def bass(t: Column, m: Column, p: Column, q: Column) -> Column:
    e = F.exp(-(p + q) * t)
    return m * (1 - e) / (1 + F.try_divide(q, p) * e)


def gompertz(t: Column, a: Column, b: Column, c: Column) -> Column:
    return a * F.exp(-b * F.exp(-c * t))


def logistic(t: Column, a: Column, b: Column, c: Column) -> Column:
    return a / (1 + F.exp(-c * (t - b)))


def fit_bass(series: DataFrame) -> DataFrame:
    """(key, m, p, q, reason) from adoption per period regressed on earlier cumulative adoption and its square.

    Cumulative adoption is scaled by its largest value first, which keeps the moments well conditioned. A key whose parabola has no positive root has null parameters and says
    so in ``reason``.
    """
    w = W.partitionBy("key").orderBy("date")
    whole = W.partitionBy("key")
    rows = series.withColumn("_n", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("_top", F.sum("value").over(whole))
    y, x = F.col("value") / F.col("_top"), F.coalesce(F.col("_n"), F.lit(0.0)) / F.col("_top")
    fit = plane(y, x, x * x)
    abc = rows.groupBy("key").agg(F.max("_top").alias("_top"), *[fit[k].alias(k) for k in ("intercept", "first", "second")])
    root = F.col("first") * F.col("first") - 4 * F.col("second") * F.col("intercept")
    m = F.when(root >= 0, F.try_divide(-F.col("first") - F.sqrt(F.greatest(root, F.lit(0.0))), 2 * F.col("second")))
    out = abc.withColumn("_m", F.when(m > 0, m))
    return out.select("key", (F.col("_m") * F.col("_top")).alias("m"), F.try_divide("intercept", "_m").alias("p"), (-F.col("_m") * F.col("second")).alias("q"),
                      F.when(F.col("_m").isNull(), F.lit("no positive root")).alias("reason"))


# Saturation levels tried, as multiples of the largest value seen.
SATURATIONS = (1.05, 1.2, 1.5, 2.0, 3.0, 5.0)


def fit_curves(series: DataFrame, curve: str, saturations: tuple[float, ...] = SATURATIONS) -> DataFrame:
    """(key, a, b, c, sse): for each saturation level the curve is a line after its own transform; the lowest squared error on
    the original scale wins (the lower level among equals)."""
    rows = indexed(series).withColumn("_top", F.max("value").over(W.partitionBy("key"))).where("_top > 0")
    grid = rows.withColumn("_s", F.explode(F.array(*[F.lit(s) for s in saturations]))).withColumn("a", F.col("_top") * F.col("_s"))
    v, t, a = F.col("value"), F.col("t"), F.col("a")
    y = F.when(v > 0, F.log(-F.log(v / a)) if curve == "gompertz" else F.log(v / (a - v)))  # only positive values have a transform; the error counts all
    fits = grid.groupBy("key", "_s", "a").agg(F.regr_slope(y, F.when(y.isNotNull(), t)).alias("_k"), F.regr_intercept(y, F.when(y.isNotNull(), t)).alias("_i"), F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_rows"))
    b, c = (F.exp("_i"), -F.col("_k")) if curve == "gompertz" else (F.try_divide(-F.col("_i"), F.col("_k")), F.col("_k"))
    shape = gompertz if curve == "gompertz" else logistic
    fits = fits.withColumn("b", b).withColumn("c", c)
    error = F.aggregate("_rows", F.lit(0.0), lambda s, x: s + F.pow(x["value"] - shape(x["t"], F.col("a"), F.col("b"), F.col("c")), F.lit(2.0)))
    best = F.min_by(F.struct("a", "b", "c", "sse"), F.struct("sse", "_s"))
    return fits.withColumn("sse", error).where(F.col("sse").isNotNull() & ~F.isnan("sse")).groupBy("key").agg(best.alias("_b")).select("key", "_b.*")


def every_key(fits: DataFrame, series: DataFrame, fitted: str, reason: str) -> DataFrame:
    """The fits with a row for each key of the series; where ``fitted`` is null the parameters are null and ``reason`` tells why."""
    keys = series.select("key").distinct()
    return keys.join(fits, "key", "left").withColumn("reason", F.when(F.col(fitted).isNull(), F.lit(reason)))


def fit_substitution(series: DataFrame, share: str = "value") -> DataFrame:
    """Share of a newer product over time: logit line per key, with the time of half substitution and the takeover time."""
    f = F.col(share)
    inside = (f > 0) & (f < 1)
    y = F.when(inside, F.log(f / (1 - f)))
    fit = indexed(series).groupBy("key").agg(F.regr_slope(y, F.when(inside, F.col("t"))).alias("b"), F.regr_intercept(y, F.when(inside, F.col("t"))).alias("a"))
    return fit.select("key", "a", "b", F.try_divide(-F.col("a"), F.col("b")).alias("half_time"), F.try_divide(F.lit(2.197224577336219) * 2, F.col("b")).alias("takeover"))


def multi_phase(t: Column, phases: list[tuple[Column, Column, Column]]) -> Column:
    """Sum of logistic phases given as (potential, midpoint, steepness)."""
    return reduce(lambda a, b: a + b, [logistic(t, m, k, r) for m, k, r in phases])


def multi_phase_rate(t: Column, phases: list[tuple[Column, Column, Column]]) -> Column:
    def slope(m, k, r):
        e = F.exp(-r * (t - k))
        return m * r * e / ((1 + e) * (1 + e))
    return reduce(lambda a, b: a + b, [slope(*x) for x in phases])


def generations(t: Column, gens: list[tuple[float, Column, Column, Column]]) -> list[Column]:
    """Adoption of successive generations (introduction time, m, p, q): later ones take over from earlier ones."""
    def reached(start, p, q):
        since = t - start
        return F.when(since <= 0, F.lit(0.0)).otherwise(bass(since, F.lit(1.0), p, q))
    f = [reached(s, p, q) for s, _, p, q in gens]
    out = []
    for i, (_, m, _, _) in enumerate(gens):
        out.append(reduce(lambda acc, later: acc * (1 - later), f[i + 1:], m * f[i]))
    return out


# ---- hierarchical growth and vector autoregression ---------------------------------------------------------------------

def hierarchical_growth(df: DataFrame, group: str, tier: str, prior: float = 2.0, roles: Roles = DEFAULT) -> DataFrame:
    """(entity, growth): global mean plus region, tier and entity effects, each shrunk by n / (n + prior)."""
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    rows = df.withColumn("g", F.when(F.lag(roles.value).over(w) > 0, F.try_divide(F.col(roles.value), F.lag(roles.value).over(w)) - 1)).where("g is not null")
    keys = list(roles.by)
    sums = rows.groupBy(*roles.entity, group, tier).agg(F.sum("g").alias("s"), F.count("g").alias("n"))

    def effect(over: list[str], taken: Column, out: str) -> DataFrame:
        n = F.sum("n").cast("double")
        return base.groupBy(*keys, *over).agg((F.sum(F.col("s") - F.col("n") * taken) / n * (n / (n + prior))).alias(out))

    mean = sums.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mu"))
    base = sums.join(mean, keys)
    by_group = effect([group], F.col("mu"), "group_effect")
    base = base.join(by_group, [*keys, group])
    by_tier = effect([tier], F.col("mu") + F.col("group_effect"), "tier_effect")
    base = base.join(by_tier, [*keys, tier])
    known = F.col("mu") + F.col("group_effect") + F.col("tier_effect")
    n = F.col("n").cast("double")
    own = (F.col("s") / n - known) * (n / (n + prior))
    return base.withColumn("entity_effect", own).withColumn("growth", known + F.col("entity_effect"))


def hierarchical_shares(latest: DataFrame, growth: DataFrame, horizon: int, roles: Roles = DEFAULT) -> DataFrame:
    """Latest shares compounded by the entity growth and rescaled per market-year."""
    from panelloom.operators.shares import SHARE, rescale_shares
    rows = latest.join(growth.select(*roles.entity, "growth"), roles.entity).withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    moved = rows.select(*roles.entity, (F.col(roles.year) + F.col("_h")).alias(roles.year), (F.col(SHARE) * F.pow(1 + F.col("growth"), F.col("_h"))).alias(SHARE))
    return rescale_shares(moved, roles)


def fit_var(df: DataFrame, first: str, second: str, key: str = "key", order_by: str = "date") -> DataFrame:
    """Two-series vector autoregression of order one per key: each series on both lags."""
    w = W.partitionBy(key).orderBy(order_by)
    a, b = F.lag(first).over(w), F.lag(second).over(w)
    rows = df.withColumn("_a", a).withColumn("_b", b)
    one, two = plane(F.col(first), F.col("_a"), F.col("_b")), plane(F.col(second), F.col("_a"), F.col("_b"))
    return rows.groupBy(key).agg(*[one[k].alias(f"a_{k}") for k in one], *[two[k].alias(f"b_{k}") for k in two],
                                 F.max_by(first, order_by).alias("last_first"), F.max_by(second, order_by).alias("last_second"))


def forecast_var(fit: DataFrame, key: str = "key") -> DataFrame:
    """Next step of both series."""
    x, y = F.col("last_first"), F.col("last_second")
    return fit.select(key, (F.col("a_intercept") + F.col("a_first") * x + F.col("a_second") * y).alias("next_first"),
                      (F.col("b_intercept") + F.col("b_first") * x + F.col("b_second") * y).alias("next_second"))


# ---- pooled learners ----------------------------------------------------------------------------------------------------

def lag_features(series: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Trend, calendar, cyclic and lag features; rows without all lags are dropped, not zero-filled."""
    w = W.partitionBy("key").orderBy("date")
    out = indexed(series).withColumn("month", F.month("date").cast("double")).withColumn("quarter", F.quarter("date").cast("double"))
    angle = F.col("month") * (2 * 3.141592653589793 / 12)
    out = out.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle))
    for k in lags:
        out = out.withColumn(f"lag{k}", F.lag("value", k).over(w))
    return out.dropna(subset=[f"lag{k}" for k in lags])


def feature_names(lags: tuple[int, ...] = (1, 2, 3)) -> list[str]:
    return ["t", "month", "quarter", "month_sin", "month_cos", *[f"lag{k}" for k in lags]]


def pooled(series: DataFrame, horizon: int, frequency: str = "M", learner: str = "boosted", lags: tuple[int, ...] = (1, 2, 3), regularization: float = 0.1,
           rounds: int = 10) -> DataFrame:
    """One model over all keys (boosted trees, ridge or lasso), applied step by step: a loop over the horizon only."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    from panelloom.functions.session import cut_lineage
    names = feature_names(lags)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    train = cut_lineage(assembler.transform(lag_features(series, lags)).select("features", F.col("value").alias("label")))
    if learner == "boosted":
        model = GBTRegressor(maxIter=rounds, maxDepth=3, seed=7).fit(train)
    else:
        model = LinearRegression(regParam=regularization, elasticNetParam=1.0 if learner == "lasso" else 0.0).fit(train)
    path = cut_lineage(series.select("key", "date", "value"))
    spread = train.agg(F.stddev_pop("label").alias("_s"))
    out = []
    depth = max(lags)
    state = path.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("date"))))
    state = state.groupBy("key").agg(F.max("date").alias("date"), F.count(F.lit(1)).cast("double").alias("t"),
                                     *[F.max(F.when(F.col("_r") == k, F.col("value"))).alias(f"lag{k}") for k in range(1, depth + 1)]).dropna()
    for h in range(1, horizon + 1):
        step = state.withColumn("date", F.add_months("date", MONTHS[frequency])).withColumn("month", F.month("date").cast("double")).withColumn("quarter", F.quarter("date").cast("double"))
        angle = F.col("month") * (2 * 3.141592653589793 / 12)
        step = step.withColumn("month_sin", F.sin(angle)).withColumn("month_cos", F.cos(angle))
        guess = model.transform(assembler.transform(step)).withColumn("horizon", F.lit(h))
        done = cut_lineage(guess.select("key", "date", "t", "horizon", *[f"lag{k}" for k in range(1, depth + 1)], F.greatest("prediction", F.lit(0.0)).alias("_v")))
        out.append(done)
        state = done.select("key", "date", (F.col("t") + 1).alias("t"), F.col("_v").alias("lag1"), *[F.col(f"lag{k - 1}").alias(f"lag{k}") for k in range(2, depth + 1)])
    rows = reduce(DataFrame.unionByName, out).transform(with_row, spread)
    return long_form(rows, f"pooled_{learner}", F.col("_v"), Z95 * F.col("_s") * 0.5)


# ---- registry ----------------------------------------------------------------------------------------------------------------

FORECASTERS: dict[str, tuple[str, str, Callable[..., DataFrame]]] = {
    "cagr": ("Compound growth", "statistical", cagr),
    "moving_average": ("Moving average", "statistical", moving_average),
    "exponential_smoothing": ("Exponential smoothing", "statistical", exponential_smoothing),
    "linear": ("Linear trend", "statistical", linear),
    "exponential": ("Exponential trend", "statistical", exponential),
    "quadratic": ("Quadratic trend", "statistical", quadratic),
    "conservative": ("Conservative growth", "statistical", conservative),
    "naive": ("Last value", "baseline", naive),
    "seasonal_naive": ("Seasonal naive", "baseline", seasonal_naive),
    "autoregressive": ("Autoregression", "statistical", autoregressive),
    "pooled": ("Pooled learner", "learned", pooled),
}


def forecaster(name: str) -> Callable[..., DataFrame]:
    """Look up by key or display name."""
    for key, (label, _, fn) in FORECASTERS.items():
        if name in (key, label):
            return fn
    raise KeyError(f"unknown forecaster {name}; known: {', '.join(FORECASTERS)}")


def register_forecaster(key: str, label: str, category: str, fn: Callable[..., DataFrame]) -> None:
    FORECASTERS[key] = (label, category, fn)


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for key, (_, category, _) in FORECASTERS.items():
        out.setdefault(category, []).append(key)
    return out


def forecast_many(series: DataFrame, models: list[str], horizon: int, frequency: str = "M", **options: dict) -> DataFrame:
    """Long table of several models over the same series, with every step of every key: see ``complete``."""
    return reduce(DataFrame.unionByName, [complete(forecaster(m)(series, horizon, frequency, **options.get(m, {})), m, series, horizon, frequency) for m in models])


#: Forecasters that have no value for some keys or steps: too short a history, or no row one season back.
PARTIAL = ("exponential_smoothing", "seasonal_naive", "autoregressive", "pooled")


def complete(main: DataFrame, model: str, series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    """The model's rows, and for keys and steps that it leaves out those of ``with_fallback`` under the model's name, with the reason."""
    known = main.withColumn("reason", F.lit(None).cast("string"))
    if model not in PARTIAL:
        return known
    rows = with_fallback(main, series, horizon, frequency)
    label = F.first(F.when(F.col("model") != "fallback", F.col("model")), True).over(W.partitionBy("key"))
    named = rows.withColumn("_label", F.coalesce(label, F.lit(model)))
    filled = F.col("model") == "fallback"
    return named.select(*[F.col("_label").alias("model") if c == "model" else F.col(c) for c in main.columns], F.when(filled, F.lit("no value of the model")).alias("reason"))


def with_fallback(main: DataFrame, series: DataFrame, horizon: int, frequency: str = "M") -> DataFrame:
    """Keys or steps the main model has no value for take the trend line, then the mean of the series."""
    line = linear(series, horizon, frequency).select("key", "date", "horizon", *[F.col(c).alias(f"_{c}") for c in ("value", "lower", "upper")])
    mean = series.groupBy("key").agg(F.avg("value").alias("_mean"))
    joined = line.join(main, ["key", "date", "horizon"], "left").join(mean, "key")
    return joined.select("key", "date", F.coalesce("model", F.lit("fallback")).alias("model"), "horizon",
                         F.coalesce("value", "_value", "_mean").alias("value"), F.coalesce("lower", "_lower", "_mean").alias("lower"),
                         F.coalesce("upper", "_upper", "_mean").alias("upper"))


def predict_at(long: DataFrame, dates: DataFrame) -> DataFrame:
    """Forecast rows at the wanted (key, date) pairs."""
    return long.join(dates.select("key", "date").distinct(), ["key", "date"], "left_semi")


def evaluate(long: DataFrame, actual: DataFrame) -> DataFrame:
    """Per model: MAE, MAPE, RMSE, Theil U on the dates both tables hold."""
    from panelloom.operators.accuracy import series_metrics
    rows = long.select("key", "date", "model", F.col("value").alias("forecast")).join(actual.select("key", "date", F.col("value").alias("actual")), ["key", "date"])
    return series_metrics(rows, ["model"])
