"""Regimes and market conditions over keyed series ``(key, date, value)``; every window stays inside one key's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, scalars as S, stats
from panelloom.functions.session import with_row

# Names of regimes by their number, confidence and uncertainty by regime type.
REGIME_NAMES = {2: ["low_volatility", "high_volatility"], 3: ["bear_market", "stable_market", "bull_market"],
                4: ["crisis", "bear_market", "stable_market", "bull_market"]}
TYPE_CONFIDENCE = {"stable": 0.98, "stable_growth": 0.97, "volatile_growth": 0.93, "volatile_stable": 0.90, "decline": 0.92, "mixed": 0.95}
TYPE_UNCERTAINTY = {"stable": 0.05, "stable_growth": 0.07, "volatile_growth": 0.15, "volatile_stable": 0.12, "decline": 0.10, "mixed": 0.13}
# Forecaster families by what they are good at.
FAMILIES = {"trend": ("linear", "autoregressive", "exponential"), "robust": ("moving_average", "naive"), "mean_revert": ("exponential_smoothing", "seasonal_naive")}


def _w():
    return W.partitionBy("key").orderBy("date")


def _full(agg: Column, count: Column, size: int) -> Column:
    return F.when(count == size, agg)


def market_metrics(series: DataFrame, window: int = 12) -> DataFrame:
    """Adds growth (fraction), rolling volatility and momentum of growth, trend strength and size against the rolling mean.

    Rolling measures need a full window of values.
    """
    w = _w()
    rows = series.withColumn("growth", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1).withColumn("_t", F.row_number().over(w).cast("double"))
    frame = w.rowsBetween(-(window - 1), 0)
    n = F.count("growth").over(frame)
    nv = F.count("value").over(frame)
    return (rows.withColumn("volatility", _full(F.stddev_samp("growth").over(frame), n, window)).withColumn("momentum", _full(F.avg("growth").over(frame), n, window))
            .withColumn("trend_strength", _full(F.abs(S.corr("_t", "value", frame)), nv, window))
            .withColumn("size_relative", _full(F.try_divide(F.col("value"), F.avg("value").over(frame)), nv, window)).drop("_t"))


def change_points(metrics: DataFrame, window: int = 12, threshold: float = 2.0, spacing: int = 6) -> DataFrame:
    """Adds ``is_change``: the mean of volatility after a row differs from the mean before it by more than ``threshold`` pooled
    deviations; of close candidates only those at least ``spacing`` rows after the last kept one count."""
    vol = metrics.where(F.col("volatility").isNotNull())
    w = _w()
    nxt, prev = w.rowsBetween(0, window - 1), w.rowsBetween(-window, -1)
    v = F.col("volatility")
    pooled = F.sqrt((F.var_samp(v).over(nxt) + F.var_samp(v).over(prev)) / 2)
    z = F.try_divide(F.abs(F.avg(v).over(nxt) - F.avg(v).over(prev)), pooled)
    full = (F.count(v).over(nxt) == window) & (F.count(v).over(prev) == window) & (F.count(v).over(w.rowsBetween(0, window)) == window + 1)
    rows = vol.withColumn("_i", F.row_number().over(w)).withColumn("_z", F.when(full, z))
    rows = rows.withColumn("_c", F.coalesce(F.col("_z") > threshold, F.lit(False)))

    def step(s: Column, x: Column) -> dict[str, Column]:
        keep = x["_c"] & (x["_i"] - s["last"] >= spacing)
        return {"last": F.when(keep, x["_i"]).otherwise(s["last"]), "keep": keep}

    marked = folds.scan_rows(rows, ["key"], "date", {"last": F.lit(-spacing), "keep": F.lit(False)}, step, lambda s, x: {"is_change": s["keep"]}, "is_change boolean")
    flags = marked.where("is_change").select("key", "date", "is_change")
    return metrics.join(flags, ["key", "date"], "left").withColumn("is_change", F.coalesce("is_change", F.lit(False)))


def classify(mean_growth: Column, growth_volatility: Column, mean_volatility: Column) -> Column:
    g, gv, mv = (F.coalesce(c, F.lit(0.0)) for c in (mean_growth, growth_volatility, mean_volatility))
    flat = F.abs(g) <= 0.02
    return (F.when((g > 0.02) & (gv < 0.1), "stable_growth").when((g > 0.02) & (gv >= 0.1), "volatile_growth").when(flat & (mv < 0.05), "stable")
            .when(flat & (mv >= 0.05), "volatile_stable").when(g < -0.02, "decline").otherwise("mixed"))


def with_regimes(changes: DataFrame) -> DataFrame:
    """Adds ``regime_id``: number of change points up to the row."""
    return changes.withColumn("regime_id", F.sum(F.col("is_change").cast("int")).over(_w().rowsBetween(W.unboundedPreceding, 0)))


def regime_table(rows: DataFrame) -> DataFrame:
    """(key, regime_id, span, characteristics, regime_type)."""
    return (rows.groupBy("key", "regime_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length"), F.avg("growth").alias("mean_growth"), F.stddev_samp("growth").alias("growth_volatility"),
        F.avg("volatility").alias("mean_volatility"), F.max("volatility").alias("max_volatility"), F.avg("momentum").alias("mean_momentum"), F.avg("trend_strength").alias("mean_trend_strength"))
        .withColumn("regime_type", classify(F.col("mean_growth"), F.col("growth_volatility"), F.col("mean_volatility"))))


def indicator_by_regime(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """(regime_type, indicator, correlation, n, p_value) over all rows of a type. ``rows`` carries key, date, regime_type, value."""
    joined = rows.select("key", "date", "regime_type", "value").join(indicators.select("key", "date", "indicator", F.col("value").alias("_x")), ["key", "date"])
    out = joined.groupBy("regime_type", "indicator").agg(S.corr("value", "_x").alias("correlation"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    out = out.withColumn("correlation", F.coalesce(S.finite("correlation"), F.lit(0.0)))
    return out.withColumn("p_value", F.coalesce(stats.p_value(stats.correlation_t(F.col("correlation"), F.col("n")), F.col("n") - 2), F.lit(1.0)))


def regime_weights(performance: DataFrame) -> DataFrame:
    """Weights per regime type: the size of a significant correlation, else 0.1, normalised."""
    raw = performance.withColumn("_w", F.when((F.col("p_value") < 0.05) & (F.col("n") >= 3), F.abs("correlation")).otherwise(F.lit(0.1)))
    return raw.withColumn("weight", F.try_divide(F.col("_w"), F.sum("_w").over(W.partitionBy("regime_type")))).drop("_w")


def adaptive_weights(base: DataFrame, performance: DataFrame, causal: DataFrame) -> DataFrame:
    """base(indicator, weight) x (0.5 + 0.5 |r|) x (0.3 + 0.7 strength), normalised. Indicator tables are definition-sized."""
    rows = base.join(performance.select("indicator", "correlation"), "indicator", "left").join(causal.select("indicator", "strength"), "indicator", "left")
    raw = (F.col("weight") * F.coalesce(0.5 + 0.5 * F.abs("correlation"), F.lit(1.0)) * F.coalesce(0.3 + 0.7 * F.col("strength"), F.lit(1.0)))
    rows = rows.withColumn("_w", raw)
    return rows.withColumn("adaptive_weight", F.try_divide(F.col("_w"), F.sum("_w").over(W.partitionBy()))).drop("_w")


def learn_weights(weights: DataFrame, mape: DataFrame, rate: float = 0.1) -> DataFrame:
    """Weight plus rate x contribution, kept in 0.01..1, normalised. An error above 20 % counts against the weight."""
    e = F.least(F.lit(1.0), F.col("mape") / 100)
    rows = weights.transform(with_row, mape.select("mape"))
    contribution = F.when(e > 0.2, -F.col("weight") * e).otherwise(F.col("weight") * (1 - e))
    rows = rows.withColumn("contribution", contribution).withColumn("_w", S.clip(F.col("weight") + rate * F.col("contribution"), 0.01, 1.0))
    rows = rows.withColumn("new_weight", F.col("_w") / F.sum("_w").over(W.partitionBy()))
    return rows.select("indicator", "weight", "contribution", "new_weight", (F.col("new_weight") - F.col("weight")).alias("change"))


def _pick(c: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def regime_parameters(regimes: DataFrame) -> DataFrame:
    """Base uncertainty, confidence and regime uncertainty for each regime row."""
    base = S.clip((F.coalesce("mean_volatility", F.lit(0.05)) + F.coalesce("growth_volatility", F.lit(0.05))) / 2, 0.02, 0.2)
    return (regimes.withColumn("base_uncertainty", base).withColumn("base_confidence", _pick(F.col("regime_type"), TYPE_CONFIDENCE, 0.95))
            .withColumn("regime_uncertainty", _pick(F.col("regime_type"), TYPE_UNCERTAINTY, 0.1)))


def weight_uncertainty(weights: DataFrame, parameters: DataFrame) -> DataFrame:
    """Per regime row and indicator: uncertainty of the weight and of the data behind it."""
    joined = parameters.select("key", "regime_id", "base_uncertainty").transform(with_row, weights)
    return (joined.withColumn("weight_uncertainty", F.greatest(F.lit(0.01), F.col("base_uncertainty") * (1.5 - F.col("weight"))))
            .withColumn("data_std", 0.02 + 0.08 * (1 - F.col("weight"))).withColumn("parameter_std", F.col("weight") * 0.1))


def regime_features(series: DataFrame, window: int = 12) -> DataFrame:
    """return, volatility, mean_return, momentum over ``window`` rows; rows with any of them missing are dropped."""
    w = _w()
    rows = series.withColumn("return", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)
    frame = w.rowsBetween(-(window - 1), 0)
    n = F.count("return").over(frame)
    return (rows.withColumn("volatility", _full(F.stddev_samp("return").over(frame), n, window)).withColumn("mean_return", _full(F.avg("return").over(frame), n, window))
            .withColumn("momentum", F.try_divide(F.col("value"), F.lag("value", window).over(w)) - 1).dropna(subset=["return", "volatility", "mean_return", "momentum"]))


def threshold_regimes(features: DataFrame, count: int = 3) -> DataFrame:
    """Regime 0..count-1 of each row by the key's own volatility quantiles (33 and 67 % for three)."""
    cuts = {2: [0.5], 3: [0.33, 0.67]}.get(count, [i / count for i in range(1, count)])
    limits = features.groupBy("key").agg(*[F.percentile("volatility", F.lit(p)).alias(f"_c{i}") for i, p in enumerate(cuts)])
    rows = features.join(limits, "key")
    hits = [(F.col("volatility") > F.col(f"_c{i}")).cast("int") for i in range(len(cuts))]
    return rows.withColumn("regime", sum(hits[1:], hits[0])).drop(*[f"_c{i}" for i in range(len(cuts))])


def volatility_regimes(features: DataFrame) -> DataFrame:
    """0 bear, 1 stable, 2 bull: outer volatility quartiles with the sign of the return."""
    limits = features.groupBy("key").agg(F.percentile("volatility", F.lit(0.25)).alias("_l"), F.percentile("volatility", F.lit(0.75)).alias("_h"))
    v, g = F.col("volatility"), F.col("return")
    regime = F.when(v <= F.col("_l"), 1).when((v <= F.col("_h")) & (g >= 0), 2).otherwise(0)
    return features.join(limits, "key").withColumn("regime", regime).drop("_l", "_h")


def mixture_regimes(features: DataFrame, count: int = 3) -> DataFrame:
    """Gaussian-mixture regimes over the standardised features of all keys."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    names = ["return", "volatility", "mean_return", "momentum"]
    steps = [VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
             GaussianMixture(featuresCol="_scaled", predictionCol="regime", probabilityCol="_p", k=count, seed=7, maxIter=20)]
    return Pipeline(stages=steps).fit(features).transform(features).drop("_raw", "_scaled", "_p")


def transitions(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """(from_regime, to_regime, n, probability) between consecutive rows of a key, rows of the matrix sum to 1."""
    steps = rows.withColumn("_next", F.lead(regime).over(_w())).where(F.col("_next").isNotNull())
    counts = steps.groupBy(F.col(regime).alias("from_regime"), F.col("_next").alias("to_regime")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy("from_regime")))


def stationary(matrix: DataFrame) -> DataFrame:
    """Long-run share of each regime. The matrix has one cell per pair of regimes, so it is solved on the driver."""
    import numpy as np
    cells = matrix.select("from_regime", "to_regime", "probability").collect()
    names = sorted({c.from_regime for c in cells} | {c.to_regime for c in cells})
    p = np.zeros((len(names), len(names)))
    for c in cells:
        p[names.index(c.from_regime), names.index(c.to_regime)] = c.probability
    a = np.vstack([p.T - np.eye(len(names)), np.ones(len(names))])
    share = np.linalg.lstsq(a, np.append(np.zeros(len(names)), 1.0), rcond=None)[0]
    return matrix.sparkSession.createDataFrame([(int(n), float(s)) for n, s in zip(names, share)], "regime int, share double")


def spells(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """(regime, spells, mean and longest length, frequency, value mean and deviation)."""
    w = _w()
    runs = rows.withColumn("_new", F.coalesce(F.col(regime) != F.lag(regime).over(w), F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    per = runs.groupBy("key", "_run", regime).agg(F.count(F.lit(1)).alias("_len"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    out = per.groupBy(F.col(regime).alias("regime")).agg(F.count(F.lit(1)).alias("spells"), F.avg("_len").alias("mean_length"), F.max("_len").alias("longest"), F.sum("_len").alias("rows"), (F.sum("_s") / F.sum("_len")).alias("mean_value"))
    return out.withColumn("frequency", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def market_conditions(series: DataFrame, lookback: int = 12) -> DataFrame:
    """State of each key over its last ``lookback`` rows: volatility and its place in history, trend, momentum, regime, phase."""
    w = _w()
    rows = series.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("key"))).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_ret", F.try_divide(F.col("value") - F.lag("value").over(w), F.lag("value").over(w)))
    # Returns inside a window of ``lookback`` values ending at the row: the first value of the window has none.
    vol = F.when(F.col("_i") >= lookback, F.stddev_pop("_ret").over(w.rowsBetween(-(lookback - 2), 0)))
    rows = rows.withColumn("_v", vol).withColumn("_tail", F.col("_i") > F.col("_n") - lookback).withColumn("_prev", F.lag("value").over(w))
    tail = lambda c: F.when(F.col("_tail"), c)
    ret = F.when(F.col("_i") > F.col("_n") - lookback + 1, F.col("_ret"))
    last = F.max_by("value", "_i")
    agg = rows.groupBy("key").agg(
        F.max("_n").alias("_n"), F.max("date").alias("date"), F.stddev_pop(ret).alias("volatility"), F.regr_slope(tail(F.col("value")), tail(F.col("_i").cast("double"))).alias("trend_slope"),
        F.abs(S.corr(tail(F.col("value")), tail(F.col("_i").cast("double")))).alias("trend_strength"), F.avg(tail(F.col("value"))).alias("_long"),
        F.avg(F.when(F.col("_i") > F.col("_n") - 5, F.col("value"))).alias("_short"), last.alias("_last"), F.max(F.when(F.col("_i") == F.col("_n") - 4, F.col("value"))).alias("_five"),
        F.stddev_pop(F.when(F.col("_i") > F.col("_n") - 5, F.col("_ret"))).alias("_rv"),
        F.abs(S.corr(F.when(F.col("_i") > F.col("_n") - lookback + 1, F.col("_prev")), F.when(F.col("_i") > F.col("_n") - lookback + 1, F.col("value")))).alias("_auto"))
    past = rows.where(F.col("_v").isNotNull() & (F.col("_i") < F.col("_n"))).select("key", F.col("_v").alias("_h"))
    place = past.join(agg.select("key", "volatility"), "key").groupBy("key").agg(
        ((F.count_if(F.col("_h") < F.col("volatility")) + F.count_if(F.col("_h") <= F.col("volatility"))) / (2 * F.count(F.lit(1)))).alias("_p"))
    v, m, t = F.col("volatility"), F.col("momentum"), F.col("trend_strength")
    r5 = F.when(F.col("_n") >= 5, F.try_divide(F.col("_last") - F.col("_five"), F.col("_five")))
    out = agg.where("_n >= 3").join(place, "key", "left").withColumn("momentum", F.try_divide(F.col("_short") - F.col("_long"), F.col("_long"))).withColumn("_r5", r5)
    regime = (F.when((v > 0.1) & (F.abs(m) > 0.05), "volatile_trending").when(v > 0.1, "volatile_sideways")
              .when((t > 0.7) & (F.abs(m) > 0.02), "stable_trending").otherwise("stable_sideways"))
    rv = F.col("_rv")
    phase = (F.when(F.col("_n") < 5, "unknown").when((F.col("_r5") > 0.1) & (rv < 0.05), "growth").when((F.col("_r5") > 0.05) & (rv > 0.05), "expansion")
             .when((F.abs("_r5") < 0.02) & (rv < 0.03), "maturity").when(F.col("_r5") < -0.05, "decline").otherwise("transition"))
    return out.select("key", "date", "volatility", F.coalesce("_p", F.lit(0.5)).alias("volatility_percentile"), "trend_slope", "trend_strength", "momentum", regime.alias("regime"),
                      phase.alias("phase"), (1 / (1 + v)).alias("stability"), F.when(F.least(F.col("_n"), F.lit(lookback)) >= 10, F.coalesce(S.finite("_auto"), F.lit(0.0))).otherwise(F.lit(0.5)).alias("predictability"))


def volatility_profile(series: DataFrame, window: int = 12) -> DataFrame:
    """Per key: mean, spread and last value of rolling return deviation, and the last value's percentile."""
    w = _w()
    rows = series.withColumn("_r", F.try_divide(F.col("value") - F.lag("value").over(w), F.lag("value").over(w)))
    # The window at a row covers the ``window`` returns before that row's own return.
    rows = rows.withColumn("_v", F.when(F.count("_r").over(w.rowsBetween(-window, -1)) == window, F.stddev_pop("_r").over(w.rowsBetween(-window, -1)))).where(F.col("_v").isNotNull())
    last = F.last("_v").over(W.partitionBy("key").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("_last", last)
    return rows.groupBy("key").agg(F.avg("_v").alias("mean_volatility"), F.stddev_pop("_v").alias("volatility_std"), F.max("_last").alias("current_volatility"),
                                   ((F.count_if(F.col("_v") < F.col("_last")) + F.count_if(F.col("_v") <= F.col("_last"))) / (2 * F.count(F.lit(1)))).alias("volatility_percentile"))


def family(model: Column | str) -> Column:
    model = S.col(model)
    out = None
    for name, members in FAMILIES.items():
        out = F.when(model.isin(*members), name) if out is None else out.when(model.isin(*members), name)
    return out.otherwise("neutral")


def tilt_weights(weights: DataFrame, profile: DataFrame, low: float = 0.02, high: float = 0.08, strength: float = 0.5) -> DataFrame:
    """Model weights (key, model, weight) tilted by the volatility regime of the key, normalised."""
    rows = weights.join(profile.select("key", "current_volatility"), "key")
    v, f = F.col("current_volatility"), family("model")
    state = F.when(v < low, "low").when(v > high, "high").otherwise("medium")
    factor = (F.when((F.col("state") == "low") & (f == "trend"), 1 + strength * 0.2)
              .when(F.col("state") == "high", F.when(f == "robust", 1 + strength * 0.3).when(f == "mean_revert", 1 + strength * 0.2).otherwise(1 - strength * 0.1)).otherwise(1.0))
    rows = rows.withColumn("state", state).withColumn("_w", F.col("weight") * factor)
    return rows.withColumn("tilted", F.col("_w") / F.sum("_w").over(W.partitionBy("key"))).drop("_w")


def recommendations(conditions: DataFrame) -> DataFrame:
    """Ensemble type, optimisation method, forecasters and window settings for the current conditions of each key."""
    v, p, g = F.col("volatility"), F.col("predictability"), F.col("regime")
    # Forecasters suggested per regime.
    picks = (F.when(g.isin("volatile_trending", "volatile_sideways"), "pooled, exponential_smoothing, moving_average").when(g == "stable_trending", "autoregressive, linear, exponential")
             .otherwise("moving_average, exponential_smoothing, autoregressive"))
    whole = lambda c: F.coalesce(c, F.lit(1e9)).cast("int")
    return conditions.select(
        "key", F.when(v > 0.1, "volatility_aware").otherwise("weighted").alias("ensemble_type"),
        F.when(p < 0.3, "diversified").when(v > 0.08, "adaptive").otherwise("performance").alias("optimization_method"), picks.alias("forecasters"),
        F.least(F.lit(24), F.greatest(F.lit(6), whole(F.try_divide(F.lit(12.0), v)))).alias("volatility_window"),
        F.least(F.lit(30), F.greatest(F.lit(10), whole(F.try_divide(F.lit(20.0), v)))).alias("performance_window"),
        S.clip(v, 0.01, 0.1).alias("min_weight"), S.clip(v * 2, 0.05, 0.3).alias("learning_rate"))


def current_regime(series: DataFrame, window: int = 12) -> DataFrame:
    """(key, regime, confidence): 0 where recent return deviation is above 1.5 times the whole history, else 1."""
    w = _w()
    rows = series.withColumn("_r", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1).where(F.col("_r").isNotNull())
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("date"))))
    agg = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(F.when(F.col("_k") <= window, F.col("_r"))).alias("recent"), F.stddev_samp("_r").alias("overall"))
    known = F.col("_n") >= window
    return agg.select("key", "recent", "overall", F.when(known & (F.col("recent") > F.col("overall") * 1.5), 0).when(known, 1).otherwise(0).alias("regime"),
                      F.when(known, 0.7).otherwise(0.5).alias("confidence"))


def error_trend(records: DataFrame, keys: list[str], order_by: str, value: str, last: int = 5, limit: float = 0.5) -> DataFrame:
    """Mean of the last records and the class of their slope; a slope counts when its p-value is below 0.05."""
    w = W.partitionBy(*keys).orderBy(F.desc(order_by))
    tail = records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    x = -F.col("_r").cast("double")
    fit = tail.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("recent_mean"), F.regr_slope(F.col(value), x).alias("slope"), S.corr(F.col(value), x).alias("_c"))
    p = F.coalesce(stats.p_value(stats.correlation_t(F.col("_c"), F.col("n")), F.col("n") - 2), F.lit(1.0))
    fit = fit.withColumn("p_value", p)
    label = (F.when(F.col("n") < 3, "insufficient_data").when(F.col("p_value") >= 0.05, "no_trend").when(F.col("slope") < -limit, "improving")
             .when(F.col("slope") > limit, "deteriorating").otherwise("stable"))
    return fit.withColumn("trend", label).drop("_c")


def regime_analysis(series: DataFrame, indicators: DataFrame, base: DataFrame, causal: DataFrame, window: int = 12) -> dict[str, DataFrame]:
    """All regime tables of one run: rows, regimes, performance, adaptive and regime weights, parameters."""
    from panelloom.functions.session import cut_lineage
    rows = cut_lineage(with_regimes(change_points(market_metrics(series, window), window)))
    regimes = cut_lineage(regime_table(rows))
    typed = rows.join(regimes.select("key", "regime_id", "regime_type"), ["key", "regime_id"])
    performance = cut_lineage(indicator_by_regime(typed, indicators))
    main = performance.groupBy("indicator").agg(F.max_by("correlation", "n").alias("correlation"))
    return {"rows": typed, "regimes": regimes, "performance": performance, "weights": adaptive_weights(base, main, causal),
            "regime_weights": regime_weights(performance), "parameters": regime_parameters(regimes)}
