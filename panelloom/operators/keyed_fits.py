"""Fits per key that need more than closed forms: order selection of autoregressions, many-regressor lines, unit-root tests with lags, effects with several confounders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import gram
from panelloom.functions.stats import t_two_sided
from panelloom.operators.forecast import MONTHS, Z95, ahead, long_form
from panelloom.operators.indicators import UNIT_ROOT_CRITICAL

#: Lags from which the order of an autoregression, or the lags of a unit-root test, are chosen.
MOST_LAGS = 5
KINDS = ("linear", "polynomial", "ridge", "lasso", "elasticnet")


# ---- unit root with lags ------------------------------------------------------------------------------------------------

def unit_root_lags(df: DataFrame, key: list[str], order_by: str, value: str = "value", most_lags: int = MOST_LAGS) -> DataFrame:
    """(key…, n, lags, t, stationary): augmented Dickey-Fuller test with a constant; the number of lagged steps (0 to ``most_lags``) has the lowest AIC.

    All numbers of lags are compared on the rows that have all lags. One packed array of sums per key serves them all: one factorisation gives the errors of every nested
    regression, and the t of the level comes from the leading block of the chosen one. Null values are left out. A key with no more rows than regressors has no t and counts as
    not stationary.
    """
    w = W.partitionBy(*key).orderBy(order_by)
    rows = df.where(F.col(value).isNotNull()).withColumn("_level", F.lag(value).over(w)).withColumn("_step", F.col(value) - F.lag(value).over(w))
    lags = [F.lag("_step", k).over(w).alias(f"_lag{k}") for k in range(1, most_lags + 1)]
    names = [f"_lag{k}" for k in range(1, most_lags + 1)]
    rows = rows.select(*key, "_level", "_step", *lags)
    whole = F.col("_level").isNotNull()
    for c in ["_step", *names]:
        whole = whole & F.col(c).isNotNull()
    columns = [F.when(whole, c) for c in (F.lit(1.0), F.col("_level"), *[F.col(c) for c in names], F.col("_step"))]
    sums = rows.groupBy(*key).agg(gram.products(columns).alias("_g"))

    def solve(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        g = gram.matrices(batch.column("_g"), most_lags + 3)
        n = g[:, 0, 0]
        errors, _ = gram.nested_errors(g)
        used = np.arange(2, most_lags + 3)  # regressors with 0, 1 ... lags
        with np.errstate(divide="ignore", invalid="ignore"):
            score = n[:, None] * np.log(errors[:, 1:] / n[:, None]) + 2 * used
            score[n[:, None] <= used + 1] = np.inf
            chosen = np.argmin(np.where(np.isnan(score), np.inf, score), axis=1)
            t = np.full(len(n), np.nan)
            for lag in np.unique(chosen):
                own = np.flatnonzero((chosen == lag) & (n > lag + 3))
                if len(own):
                    inverse = np.linalg.pinv(g[own][:, :lag + 2, :lag + 2], rcond=1e-14, hermitian=True)
                    slope = np.einsum("gj,gj->g", inverse[:, 1], g[own, :lag + 2, -1])
                    t[own] = slope / np.sqrt(errors[own, lag + 1] / (n[own] - lag - 2) * inverse[:, 1, 1])
        t = np.where(np.isfinite(t), t, np.nan)
        return {"n": n.astype(np.int64), "lags": chosen.astype(np.int32), "t": t, "stationary": np.nan_to_num(t, nan=0.0) < UNIT_ROOT_CRITICAL}

    return gram.solved(sums, solve, key, "n long, lags int, t double, stationary boolean")


# ---- autoregressions of chosen order --------------------------------------------------------------------------------------

def differencing_order(series: DataFrame, most: int = 2, lags: int = MOST_LAGS) -> DataFrame:
    """(key, d): how often a series is differenced until the unit-root test passes, at most ``most`` times; where it never passes, once."""
    w = W.partitionBy("key").orderBy("date")
    rows, tests = series.select("key", "date", F.col("value").alias("_d0")), series.select("key").distinct()
    for d in range(most + 1):
        tests = tests.join(unit_root_lags(rows, ["key"], "date", f"_d{d}", lags).select("key", F.col("stationary").alias(f"_s{d}")), "key", "left")
        rows = rows.withColumn(f"_d{d + 1}", F.col(f"_d{d}") - F.lag(f"_d{d}").over(w))
    first = F.coalesce(*[F.when(F.col(f"_s{d}"), F.lit(d)) for d in range(most + 1)], F.lit(min(1, most)))
    return tests.select("key", first.cast("int").alias("d"))


def durbin_levinson(gamma: Column, n: Column, most: int) -> Column:
    """The autoregression of lowest AICc among the orders 0 to ``most``, from autocovariances 0 to ``most``: struct of p, phi (array), variance, score.

    The recursion goes from each order's coefficients to the next one's, as one fold over the orders.
    """
    def score(v: Column, p: Column) -> Column:
        spare = n - p - 2
        return F.when((v > 0) & (spare > 0), n * F.log(v) + 2 * (p + 1) + F.try_divide(2 * (p + 1) * (p + 2), spare))

    none = F.expr("CAST(array() AS array<double>)")
    zero = F.struct(none.alias("phi"), F.get(gamma, 0).alias("v"))
    best = F.struct(score(F.get(gamma, 0), F.lit(0)).alias("score"), F.lit(0).alias("p"), none.alias("phi"), F.get(gamma, 0).alias("variance"))

    def step(acc: Column, k: Column) -> Column:
        phi, v = acc["now"]["phi"], acc["now"]["v"]
        known = F.aggregate(F.transform(phi, lambda a, i: a * F.get(gamma, k - 1 - i)), F.lit(0.0), lambda s, x: s + x)
        turn = F.coalesce(F.try_divide(F.get(gamma, k) - known, v), F.lit(0.0))

        def after(r: Column) -> Column:
            new = F.concat(F.transform(phi, lambda a, i: a - r * F.get(phi, F.size(phi) - 1 - i)), F.array(r))
            v2 = v * (1 - r * r)
            now = F.struct(new.alias("phi"), v2.alias("v"))
            mine = F.struct(score(v2, k).alias("score"), k.alias("p"), new.alias("phi"), v2.alias("variance"))
            better = mine["score"].isNotNull() & (acc["best"]["score"].isNull() | (mine["score"] < acc["best"]["score"]))
            return F.struct(now.alias("now"), F.when(better, mine).otherwise(acc["best"]).alias("best"))

        return F.element_at(F.transform(F.array(turn), after), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(zero.alias("now"), best.alias("best")), step, lambda a: a["best"])


def select_order(series: DataFrame, orders: DataFrame | None = None, most: int = MOST_LAGS) -> DataFrame:
    """(key, n, d, p, phi, mean, variance, last_date, tail, reason): an autoregression of each key's own order.

    ``orders`` (key, d) says how often a series is differenced (else ``differencing_order``); the order p has the lowest AICc. Autocovariances come from one window pass and one aggregate.
    ``tail`` holds the last ``most + 2`` values. Every key has a row: a series of fewer than 3 steps, or one whose steps never change, has order 0 and says so in ``reason``. Rows with null values are
    left out.
    """
    w = W.partitionBy("key").orderBy("date")
    whole = W.partitionBy("key")
    known = series.where(F.col("value").isNotNull() & F.col("date").isNotNull())
    orders = differencing_order(known) if orders is None else orders
    step1 = F.col("value") - F.lag("value").over(w)
    rows = known.join(orders.select("key", "d"), "key", "left").withColumn("d", F.coalesce("d", F.lit(1)))
    rows = rows.withColumn("_1", step1).withColumn("_2", F.col("_1") - F.lag("_1").over(w))
    rows = rows.withColumn("_x", F.when(F.col("d") == 0, F.col("value")).when(F.col("d") == 1, F.col("_1")).otherwise(F.col("_2")))
    rows = rows.withColumn("_back", F.row_number().over(whole.orderBy(F.desc("date")))).withColumn("_mean", F.avg("_x").over(whole)).withColumn("_c", F.col("_x") - F.col("_mean"))
    lagged = rows.select("key", "date", "value", "d", "_back", "_mean", "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, most + 1)])
    sums = lagged.groupBy("key").agg(
        F.count("_c").alias("n"), F.max("d").alias("d"), F.max("_mean").alias("mean"), F.max("date").alias("last_date"),
        F.array(*[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}" if k else "_c")), F.lit(0.0)) for k in range(most + 1)]).alias("_sums"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_back") <= most + 2, F.struct("date", "value")))), lambda s: s["value"]).alias("tail"))
    count = F.col("n").cast("double")
    fit = sums.withColumn("_b", durbin_levinson(F.transform("_sums", lambda s: F.coalesce(F.try_divide(s, count), F.lit(0.0))), count, most))
    reason = F.when(F.col("n") < 3, "fewer than 3 steps").when(F.get("_sums", 0) <= 0, "steps never change")
    return fit.select("key", "n", "d", F.col("_b.p").cast("int").alias("p"), F.col("_b.phi").alias("phi"), F.coalesce("mean", F.lit(0.0)).alias("mean"),
                      F.coalesce("_b.variance", F.lit(0.0)).alias("variance"), "last_date", "tail", reason.alias("reason"))


def autoregression(series: DataFrame, horizon: int, frequency: str = "M", orders: DataFrame | None = None, most: int = MOST_LAGS) -> DataFrame:
    """Forecasts of every key and step by the autoregression that ``select_order`` fits, differences summed up again; with ``reason`` (null: as fitted).

    The band is 1.96 deviations that grow with the root of the step for differenced series. A key with one value keeps it.
    """
    fit = select_order(series, orders, most)
    levels = F.col("tail")
    ones = F.transform(levels, lambda v, i: v - F.get(levels, i - 1))
    twos = F.transform(ones, lambda v, i: v - F.get(ones, i - 1))
    moves = F.when(F.col("d") == 0, levels).when(F.col("d") == 1, ones).otherwise(twos)
    recent = F.reverse(F.transform(F.slice(moves, -F.col("p"), F.col("p")), lambda v: F.coalesce(v - F.col("mean"), F.lit(0.0))))
    start = F.struct(F.when(F.col("p") > 0, recent).otherwise(F.expr("CAST(array() AS array<double>)")).alias("c"), F.element_at(levels, -1).alias("level"),
                     F.when(F.size(levels) > 1, F.element_at(levels, -1) - F.element_at(levels, -2)).otherwise(F.lit(0.0)).alias("slope"), F.expr("CAST(array() AS array<double>)").alias("path"))

    def step(acc: Column, _: Column) -> Column:
        change = F.aggregate(F.zip_with("phi", acc["c"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

        def after(c: Column) -> Column:
            x = c + F.col("mean")
            slope = F.when(F.col("d") == 2, acc["slope"] + x).otherwise(x)
            level = F.when(F.col("d") == 0, x).otherwise(acc["level"] + slope)
            kept = F.when(F.col("p") > 0, F.slice(F.concat(F.array(c), acc["c"]), F.lit(1), F.greatest(F.col("p"), F.lit(1)))).otherwise(acc["c"])
            return F.struct(kept.alias("c"), level.alias("level"), slope.alias("slope"), F.concat(acc["path"], F.array(level)).alias("path"))

        return F.element_at(F.transform(F.array(change), after), 1)

    grown = fit.where(F.size("tail") > 0).withColumn("_path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda a: a["path"]))
    rows = ahead(grown, horizon, frequency).withColumn("_v", F.get("_path", F.col("horizon") - 1))
    spread = F.sqrt(F.greatest("variance", F.lit(0.0))) * F.when(F.col("d") > 0, F.sqrt(F.col("horizon").cast("double"))).otherwise(F.lit(1.0))
    reasons = rows.select("key", "horizon", "reason")
    return long_form(rows, "autoregression", F.col("_v"), Z95 * spread, None).join(reasons, ["key", "horizon"])


# ---- lines with many regressors per key --------------------------------------------------------------------------------------

def _regressors(kind: str, degree: int, seasonal: bool) -> tuple[list[str], list]:
    """Names and NumPy functions (of years since the first row, month) of the regressors that the calendar gives."""
    powers = degree if kind == "polynomial" else 1
    names = [f"trend{p}" for p in range(1, powers + 1)] + ([f"month{m}" for m in range(2, 13)] if seasonal else [])
    return names, [lambda u, m, p=p: u ** p for p in range(1, powers + 1)] + ([lambda u, m, k=k: (m == k).astype(float) for k in range(2, 13)] if seasonal else [])


def keyed_regression(series: DataFrame, horizon: int, frequency: str = "M", kind: str = "linear", degree: int = 2, alpha: float = 1.0, l1_ratio: float = 0.5, seasonal: bool = True,
                     lags: tuple[int, ...] = ()) -> DataFrame:
    """Every key's own regression on trend (and its powers), months and lags, carried ahead step by step: the long table with ``coefficients`` (intercept first).

    ``linear`` and ``polynomial`` are least squares, ``ridge`` minimises |y - Xw|^2 + alpha |w|^2, ``lasso`` and ``elasticnet`` |y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)
    (l1_ratio 1 for lasso), the intercept free in all. The sums of products of a key are one packed array, merged in every task before the shuffle; keys are solved and carried ahead
    thousands at a time. Where regressors of a key depend on each other (a month that never occurs, fewer rows than regressors) the smallest solution is taken, so every key has every
    step. Rows with null values, and with ``lags`` the rows before the first full lag, are not fitted.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known: {', '.join(KINDS)}")
    names, functions = _regressors(kind, degree, seasonal)
    deepest = max(lags, default=0)
    w, whole = W.partitionBy("key").orderBy("date"), W.partitionBy("key")
    rows = series.where(F.col("value").isNotNull() & F.col("date").isNotNull())
    month = F.month("date")
    rows = rows.withColumn("_first", F.min("date").over(whole)).withColumn("_u", (F.year("date") - F.year("_first")) + (month - F.month("_first")) / 12)
    rows = rows.withColumn("_back", F.row_number().over(whole.orderBy(F.desc("date"))))
    rows = rows.select("key", "date", "value", "_first", "_u", "_back", *[F.lag("value", k).over(w).alias(f"_lag{k}") for k in lags])
    fitted = F.lit(True)
    for k in lags:
        fitted = fitted & F.col(f"_lag{k}").isNotNull()
    powers = sum(n.startswith("trend") for n in names)
    columns = [F.lit(1.0), *[F.pow("_u", F.lit(float(p))) for p in range(1, powers + 1)], *([(F.month("date") == m).cast("double") for m in range(2, 13)] if seasonal else []),
               *[F.col(f"_lag{k}") for k in lags], F.col("value")]
    sums = rows.groupBy("key").agg(
        gram.products([F.when(fitted, c) for c in columns]).alias("_g"), F.max("date").alias("last_date"), F.min("_first").alias("_first"), F.avg("value").alias("_level"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_back") <= max(deepest, 1), F.struct("date", "value")))), lambda s: s["value"]).alias("_tail"))
    q, months = len(columns), MONTHS[frequency]
    sums = sums.withColumn("_m0", F.month("last_date")).withColumn("_span", (F.year("last_date") - F.year("_first")) * 12 + F.month("last_date") - F.month("_first"))

    def solve(batch: pa.RecordBatch) -> dict[str, pa.Array | np.ndarray]:
        n, mean, cov = gram.centred(gram.matrices(batch.column("_g"), q))
        c, y = cov[:, :-1, :-1], cov[:, :-1, -1]
        if kind in ("linear", "polynomial"):
            coef = gram.least_squares(c, y)
        elif kind == "ridge":
            coef = gram.least_squares(c, y, alpha / np.maximum(n, 1))
        else:
            share = 1.0 if kind == "lasso" else l1_ratio
            coef = gram.coordinate_descent(c, y, alpha * share, alpha * (1 - share))
        level = batch.column("_level").to_numpy(zero_copy_only=False)
        intercept = np.where(n > 0, mean[:, -1] - np.einsum("gj,gj->g", coef, mean[:, :-1]), level)
        error = cov[:, -1, -1] - 2 * np.einsum("gj,gj->g", coef, y) + np.einsum("gi,gij,gj->g", coef, c, coef)
        span, m0 = batch.column("_span").to_numpy().astype(float), batch.column("_m0").to_numpy()
        past = np.full((len(n), max(deepest, 1)), np.nan)
        for i, own in enumerate(batch.column("_tail").to_pylist()):
            if own:
                past[i, -len(own):] = own
        past = np.where(np.isnan(past), level[:, None], past)  # a history shorter than the lags is carried on from its mean
        path = []
        for h in range(1, horizon + 1):
            u, m = (span + h * months) / 12, (m0 - 1 + h * months) % 12 + 1
            x = np.column_stack([*[f(u, m) for f in functions], *[past[:, -k] for k in lags]])
            value = intercept + np.einsum("gj,gj->g", coef, x)
            path.append(value)
            past = np.column_stack([past[:, 1:], value])
        lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        return {"_path": lists(np.column_stack(path)), "_s": np.sqrt(np.maximum(error, 0.0)), "coefficients": lists(np.column_stack([intercept, coef]))}

    fit = gram.solved(sums, solve, ["key", "last_date"], "_path array<double>, _s double, coefficients array<double>")
    rows = ahead(fit, horizon, frequency).withColumn("_v", F.get("_path", F.col("horizon") - 1))
    return long_form(rows, f"keyed_{kind}", F.col("_v"), Z95 * F.col("_s")).join(fit.select("key", "coefficients"), "key")


# ---- effects over sliding windows with several confounders ----------------------------------------------------------------------

def rolling_effects(df: DataFrame, treatment: str, outcome: str, confounders: list[str], key: str = "key", order_by: str = "date", window: int = 12) -> DataFrame:
    """(key, order_by, effect, correlation, p_value): partial slope of outcome on treatment given all confounders over the ``window`` rows before each row.

    The sums of products slide with the window inside Spark; the confounders are swept out of treatment and outcome for whole Arrow batches of rows at a time, and so are the p-values of the
    partial correlation (window - 2 degrees of freedom). Confounders that depend on each other count once. Rows with a null among the columns are no part of a window; where treatment or
    outcome is explained by the confounders, effect and correlation are null and p is 1.
    """
    frame = W.partitionBy(key).orderBy(order_by).rowsBetween(-window, -1)
    names = [*confounders, treatment, outcome]
    rows = df.dropna(subset=names)
    # products lose digits far from 0, so every column is measured from its key's mean
    rows = rows.select(key, order_by, *[(F.col(c) - F.avg(c).over(W.partitionBy(key))).cast("double").alias(c) for c in names])
    sums = rows.select(key, order_by, F.count(F.lit(1)).over(frame).alias("_n"), gram.products([F.lit(1.0), *[F.col(c) for c in names]], frame).alias("_g")).where(F.col("_n") == window)
    q, z = len(names) + 1, len(confounders)

    def solve(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        n, _, cov = gram.centred(gram.matrices(batch.column("_g"), q))
        own = cov[:, z:, z:].copy()
        scale = np.einsum("gii->gi", own).copy()
        if z:
            for j in (0, 1):
                slope = gram.least_squares(cov[:, :z, :z], cov[:, :z, z + j])
                own[:, j] -= np.einsum("gk,gkj->gj", slope, cov[:, :z, z:])
        tt, ty, yy = own[:, 0, 0], own[:, 0, 1], own[:, 1, 1]
        free = (tt > 1e-9 * scale[:, 0]) & (yy > 1e-9 * scale[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            effect = np.where(free, ty / tt, np.nan)
            r = np.where(free, np.clip(ty / np.sqrt(tt * yy), -1, 1), np.nan)
            t = r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-300))
        p = np.ones(len(r))
        if free.any():
            p[free] = t_two_sided(t[free], n[free] - 2)
        return {"effect": effect, "correlation": r, "p_value": p}

    return gram.solved(sums, solve, [key, order_by], "effect double, correlation double, p_value double")
