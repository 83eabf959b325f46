"""Indicator analysis on the long panel ``(id, year, indicator, value, market_value)``.

Statistics per indicator run over the whole panel, so they are aggregates or use distributed ranks; windows stay inside one
entity's history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import scalars as S, stats
from panelloom.operators import warping
from panelloom.operators.shares import SHARE, rescale_shares
from panelloom.roles import DEFAULT, Roles

# Cumulative Poisson(1) probabilities for bootstrap row weights 0..7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
# 5 % critical value of the Dickey-Fuller t with a constant.
UNIT_ROOT_CRITICAL = -2.86


def build_panel(base: DataFrame, values: DataFrame, ranks: DataFrame | None, names: list[str], keys: tuple[str, ...] = ("id", "year")) -> DataFrame:
    """base(id, year, market_value) with one column per value indicator, and year-free rank indicators joined on the entity."""
    wide = values.groupBy(*keys).pivot("indicator", names).agg(F.first("value"))
    out = base.join(wide, list(keys), "left")
    return out if ranks is None else out.join(ranks, [k for k in keys if k != "year"], "left")


def fill(df: DataFrame, columns: list[str], key: list[str], order_by: str = "year") -> DataFrame:
    """Forward then backward fill inside each entity."""
    w = W.partitionBy(*key).orderBy(order_by)
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return df.select(*[c for c in df.columns if c not in columns],
                     *[F.coalesce(F.last(c, True).over(up), F.first(c, True).over(down)).alias(c) for c in columns])


def pearson(df: DataFrame, by: list[str], x: str = "value", y: str = "market_value", minimum: int = 10) -> DataFrame:
    """(by…, n, pearson, t, p_value), correlation 0 below the minimum number of rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.where(both).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), S.corr(x, y).alias("_r"))
    enough = F.col("n") >= minimum
    out = out.withColumn("pearson", F.when(enough, F.coalesce(S.finite("_r"), F.lit(0.0))).otherwise(F.lit(0.0))).drop("_r")
    out = out.withColumn("t", F.when(enough, stats.correlation_t(F.col("pearson"), F.col("n"))))
    return out.withColumn("p_value", F.coalesce(stats.p_value(F.col("t"), F.col("n") - 2), F.lit(1.0)))


def lagged(df: DataFrame, max_lag: int = 5, key: tuple[str, ...] = ("id",), order_by: str = "year") -> DataFrame:
    """(indicator, lag, correlation, n): indicator now against the market ``lag`` rows later (earlier when negative).

    All lags come from one window pass inside the entity and one aggregate.
    """
    w = W.partitionBy(*key, "indicator").orderBy(order_by)
    lags = list(range(-max_lag, max_lag + 1))
    rows = df.select("indicator", "value", *[(F.lead("market_value", k) if k >= 0 else F.lag("market_value", -k)).over(w).alias(f"_l{k}") for k in lags])
    cells = [F.struct(F.lit(k).alias("lag"), F.coalesce(S.corr("value", f"_l{k}"), F.lit(0.0)).alias("correlation"), F.count(f"_l{k}").alias("n")) for k in lags]
    return rows.groupBy("indicator").agg(F.array(*cells).alias("_c")).select("indicator", F.inline("_c"))


def best_lag(lags: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("lag", "correlation"), F.struct(F.round(F.abs("correlation"), 12), -F.abs("lag"), "lag"))
    return lags.groupBy("indicator").agg(best.alias("_b")).select("indicator", F.col("_b.lag").alias("best_lag"), F.col("_b.correlation").alias("correlation"))


def rolling(df: DataFrame, key: list[str], order_by: str, x: str, y: str, window: int = 12) -> DataFrame:
    """Adds ``rolling_corr`` over a full window of rows inside one entity."""
    frame = W.partitionBy(*key).orderBy(order_by).rowsBetween(-(window - 1), 0)
    return df.withColumn("rolling_corr", F.when(F.count(F.when(F.col(x).isNotNull(), F.col(y))).over(frame) == window, S.corr(x, y, frame)))


def rolling_summary(rows: DataFrame, by: list[str], key: list[str], order_by: str) -> DataFrame:
    """Mean, spread, stability and trend (mean slope over entities) of rolling correlations."""
    numbered = rows.where(F.col("rolling_corr").isNotNull()).withColumn("_i", F.row_number().over(W.partitionBy(*key).orderBy(order_by)).cast("double"))
    slopes = numbered.groupBy(*by, *[k for k in key if k not in by]).agg(F.regr_slope("rolling_corr", "_i").alias("_s"))
    trend = slopes.groupBy(*by).agg(F.avg("_s").alias("trend"))
    out = numbered.groupBy(*by).agg(F.avg("rolling_corr").alias("mean"), F.stddev_samp("rolling_corr").alias("std"))
    return out.withColumn("stability", 1 - F.col("std") / (F.abs("mean") + 1e-8)).join(trend, by)


def information_weights(df: DataFrame, criterion: str = "aic", x: str = "value", y: str = "market_value") -> DataFrame:
    """Weights 1 / (1 + criterion) of a single-variable fit per indicator, normalised."""
    n = F.count(F.lit(1)).cast("double")
    fit = df.groupBy("indicator").agg(n.alias("n"), (F.var_pop(y) * (1 - F.regr_r2(y, x))).alias("mse"))
    loglik = -0.5 * F.col("n") * F.log(2 * 3.141592653589793 * F.col("mse")) - F.col("n") / 2
    penalty = F.lit(4.0) if criterion == "aic" else 2 * F.log("n")
    fit = fit.withColumn(criterion, penalty - 2 * loglik).withColumn("_w", 1 / (1 + F.col(criterion)))
    return fit.withColumn("weight", F.try_divide(F.col("_w"), F.sum("_w").over(W.partitionBy()))).drop("_w")


def forest_weights(panel: DataFrame, names: list[str], y: str = "market_value", trees: int = 20) -> DataFrame:
    """Feature importance of a distributed random forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(panel.dropna(subset=[*names, y]))
    model = RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=5, seed=7).fit(rows)
    return panel.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, model.featureImportances.toArray())], "indicator string, weight double")


def blend_weights(df: DataFrame, bins: int = 10, x: str = "value", y: str = "market_value") -> DataFrame:
    """0.4 |correlation| + 0.3 mutual information (binned) + 0.3 stability per indicator, normalised."""
    agg = df.groupBy("indicator").agg(F.coalesce(F.abs(S.corr(x, y)), F.lit(0.0)).alias("correlation"), (1 / (1 + F.stddev_samp(x) / (F.abs(F.avg(x)) + 1e-8))).alias("stability"),
                                      F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    binned = df.join(agg, "indicator").select("indicator", stats.histogram_bin(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("_bx"),
                                              stats.histogram_bin(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("_by"), F.lit(1).alias("_n"))
    mi = stats.mutual_information(binned, ["indicator"], "_bx", "_by")
    out = agg.join(mi, "indicator").withColumn("_w", 0.4 * F.col("correlation") + 0.3 * F.col("mutual_information") + 0.3 * F.col("stability"))
    return out.withColumn("weight", F.col("_w") / F.sum("_w").over(W.partitionBy())).select("indicator", "correlation", "mutual_information", "stability", "weight")


def ensemble_weights(information: DataFrame, forest: DataFrame, blend: DataFrame, method: str = "ensemble") -> DataFrame:
    rows = (information.select("indicator", F.col("weight").alias("information")).join(forest.select("indicator", F.col("weight").alias("forest")), "indicator")
            .join(blend.select("indicator", F.col("weight").alias("blend")), "indicator"))
    mixed = {"ensemble": 0.3 * F.col("information") + 0.4 * F.col("forest") + 0.3 * F.col("blend")}
    return rows.withColumn("weight", mixed.get(method, F.col(method) if method in ("information", "forest", "blend") else F.col("forest")))


def features(df: DataFrame, key: list[str], order_by: str, value: str = "value") -> DataFrame:
    """Moving averages, volatility, acceleration, momentum, z-score and percent rank inside each entity."""
    w = W.partitionBy(*key).orderBy(order_by)
    whole = W.partitionBy(*key)
    v = F.col(value)
    out = df
    for k in (3, 6, 12):
        frame = w.rowsBetween(-(k - 1), 0)
        out = out.withColumn(f"ma{k}", F.when(F.count(v).over(frame) == k, F.avg(v).over(frame)))
    for k in (6, 12):
        frame = w.rowsBetween(-(k - 1), 0)
        out = out.withColumn(f"vol{k}", F.when(F.count(v).over(frame) == k, F.stddev_samp(v).over(frame)))
    out = out.withColumn("acceleration", v - 2 * F.lag(v).over(w) + F.lag(v, 2).over(w))
    for k in (3, 6):
        out = out.withColumn(f"momentum{k}", F.try_divide(v, F.lag(v, k).over(w)) - 1)
    ties = F.count(F.lit(1)).over(W.partitionBy(*key, value))
    return (out.withColumn("zscore", (v - F.avg(v).over(whole)) / (F.stddev_samp(v).over(whole) + 1e-8))
            .withColumn("rank", (F.rank().over(whole.orderBy(value)) + (ties - 1) / 2) / F.count(v).over(whole)))


def unit_root(df: DataFrame, key: list[str], order_by: str, value: str = "value") -> DataFrame:
    """(key…, t, stationary): Dickey-Fuller t of the lagged level in a regression of the step, no further lags."""
    w = W.partitionBy(*key).orderBy(order_by)
    rows = df.withColumn("_p", F.lag(value).over(w)).withColumn("_d", F.col(value) - F.lag(value).over(w)).where(F.col("_p").isNotNull() & F.col("_d").isNotNull())
    n = F.count(F.lit(1)).cast("double")
    fit = rows.groupBy(*key).agg(n.alias("n"), F.regr_slope("_d", "_p").alias("_b"), F.regr_r2("_d", "_p").alias("_r2"), F.var_pop("_d").alias("_vd"), F.var_pop("_p").alias("_vp"))
    error = F.sqrt(F.try_divide(F.col("_vd") * (1 - F.col("_r2")), F.col("_vp") * (F.col("n") - 2)))
    return fit.select(*key, F.try_divide(F.col("_b"), error).alias("t")).withColumn("stationary", F.coalesce(F.col("t") < UNIT_ROOT_CRITICAL, F.lit(False)))


def stationary(df: DataFrame, key: list[str], order_by: str, method: str = "diff", value: str = "value") -> DataFrame:
    """Adds ``stationary_value`` and ``transformations``: difference (twice where a unit root remains and more than ten rows are
    left), log-difference for positive series, or detrended by a line."""
    w = W.partitionBy(*key).orderBy(order_by)
    v = F.col(value)
    if method == "detrend":
        whole = W.partitionBy(*key)
        rows = df.withColumn("_i", F.row_number().over(w).cast("double"))
        slope = F.coalesce(F.regr_slope(value, "_i").over(whole), F.lit(0.0))
        line = F.avg(v).over(whole) + slope * (F.col("_i") - F.avg("_i").over(whole))
        return rows.withColumn("stationary_value", v - line).withColumn("transformations", F.lit("detrend")).drop("_i")
    step = v - F.lag(v).over(w)
    if method == "log_diff":
        positive = F.min(v).over(W.partitionBy(*key)) > 0
        log = F.log(v) - F.log(F.lag(v).over(w))
        return (df.withColumn("stationary_value", F.when(positive, log).otherwise(step))
                .withColumn("transformations", F.when(positive, "log, first_difference").otherwise("first_difference")))
    rows = df.withColumn("_d", step)
    test = unit_root(rows.where(F.col("_d").isNotNull()), key, order_by, "_d").drop("t")
    counted = rows.join(test, key, "left").withColumn("_n", F.count("_d").over(W.partitionBy(*key)))
    twice = (F.col("_n") > 10) & ~F.coalesce(F.col("stationary"), F.lit(False))
    second = F.col("_d") - F.lag("_d").over(w)
    return (counted.withColumn("stationary_value", F.when(twice, second).otherwise(F.col("_d")))
            .withColumn("transformations", F.when(twice, "first_difference, second_difference").otherwise("first_difference")).drop("_d", "_n", "stationary"))


def drop_collinear(panel: DataFrame, names: list[str], threshold: float = 10.0) -> tuple[list[str], DataFrame]:
    """Names kept after dropping, one at a time, the column with the highest variance inflation; and the last inflation table.

    One distributed pass gives the correlation matrix (as many rows as columns); the loop works on that small matrix.
    """
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(panel.dropna(subset=names)).select("_v")
    matrix = Correlation.corr(rows, "_v").head()[0].toArray()
    kept = list(range(len(names)))
    while len(kept) > 1:
        vif = np.diag(np.linalg.pinv(matrix[np.ix_(kept, kept)]))
        if vif.max() <= threshold:
            break
        kept.pop(int(vif.argmax()))
    vif = np.diag(np.linalg.pinv(matrix[np.ix_(kept, kept)]))
    table = [(names[k], float(v), True) for k, v in zip(kept, vif)] + [(names[i], None, False) for i in range(len(names)) if i not in kept]
    return [names[k] for k in kept], panel.sparkSession.createDataFrame(table, "indicator string, vif double, kept boolean")


def poisson_weight(u: Column) -> Column:
    """Bootstrap weight of a row from a number in [0, 1)."""
    return reduce(lambda a, b: a + b, [(u >= p).cast("int") for p in POISSON])


def bootstrap(df: DataFrame, by: list[str], row_keys: list[str], x: str, y: str, replicates: int = 50) -> DataFrame:
    """Mean, deviation, 95 % interval and confidence of a correlation over key-hashed Poisson replicates.

    Replicates are merged map-side into moments, so the shuffle carries one row per group, replicate and partition.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("_w", poisson_weight(S.key_uniform(*by, *row_keys, "rep")).cast("double"))
    w, a, b = F.col("_w"), F.col(x), F.col(y)
    m = rows.groupBy(*by, "rep").agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    r = F.try_divide(F.col("n") * F.col("ab") - F.col("a") * F.col("b"), F.sqrt((F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * (F.col("n") * F.col("bb") - F.col("b") * F.col("b"))))
    out = m.withColumn("_r", r).groupBy(*by).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"), F.percentile("_r", F.lit(0.025)).alias("lower"), F.percentile("_r", F.lit(0.975)).alias("upper"))
    return out.withColumn("confidence", S.clip(1 - F.col("std") / (F.abs("mean") + 1e-8), 0.0, 1.0))


def entity_scores(values: DataFrame, weights: DataFrame, key: list[str], order_by: str = "year") -> DataFrame:
    """(key…, score): product over indicators of 1 + w (0.75 + 0.5 v / (v + 1) - 1) with the latest value, kept in 0.5..1.5."""
    latest = values.groupBy(*key, "indicator").agg(F.max_by("value", order_by).alias("_v"))
    rows = latest.join(weights.select("indicator", "weight").where("weight > 0"), "indicator")
    scaled = 0.75 + F.try_divide(F.col("_v"), F.col("_v") + 1) * 0.5
    factor = 1 + F.col("weight") * (scaled - 1)
    return rows.groupBy(*key).agg(F.exp(F.sum(F.log(factor))).alias("_s")).select(*key, S.clip("_s", 0.5, 1.5).alias("score"))


def adjust_shares(shares: DataFrame, scores: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Shares times the score of their entity, rescaled to 100 per market-year."""
    rows = shares.join(scores, roles.id, "left").withColumn(SHARE, F.col(SHARE) * F.coalesce("score", F.lit(1.0))).select(*shares.columns)
    return rescale_shares(rows, roles)


def influence_level(weight: Column | str) -> Column:
    return S.bands(weight, [(0.1, "Very High"), (0.05, "High"), (0.02, "Medium"), (0.01, "Low")], "Very Low")


def impact_level(score: Column | str) -> Column:
    return S.bands(score, [(1.3, "Very Positive"), (1.1, "Positive"), (0.9, "Neutral"), (0.7, "Negative")], "Very Negative")


def warping_similarity(df: DataFrame, key: list[str], order_by: str, x: str, y: str, band: int | None = None) -> DataFrame:
    """(key…, similarity): 1 - warping distance / (n + m) of min-max scaled series, see ``warping.similarities``; rows with a null are left out."""
    return warping.similarities(df.select(*key, order_by, x, y).dropna(), key, order_by, x, y, band).select(*key, "similarity")


def analysis_record(df: DataFrame, rows_key: list[str]) -> DataFrame:
    """One row per indicator: correlations, best lag, blend weight, bootstrap confidence and influence level."""
    base = pearson(df, ["indicator"])
    ranks = stats.spearman(df, ["indicator"], "value", "market_value")
    lag = best_lag(lagged(df)).withColumnRenamed("correlation", "best_lag_correlation")
    weights = blend_weights(df).select("indicator", "weight")
    boot = bootstrap(df, ["indicator"], rows_key, "value", "market_value", 20).select("indicator", "confidence")
    out = reduce(lambda a, b: a.join(b, "indicator"), [base, ranks, lag, weights, boot])
    return out.withColumn("influence", influence_level("weight"))
