"""Ensembles over the long forecast table ``(key, date, model, horizon, value)`` and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, scalars as S
from panelloom.operators import forecast as fc, regimes as rg


def simple(long: DataFrame, method: str = "mean", trim: float = 0.1) -> DataFrame:
    """Mean, median or trimmed mean over models by date with a 1.96 deviation band. Groups hold one row per model."""
    keys = ["key", "date", "horizon"]
    if method == "trimmed_mean":
        w = W.partitionBy(*keys)
        rows = long.withColumn("_r", F.row_number().over(w.orderBy("value", "model"))).withColumn("_n", F.count(F.lit(1)).over(w))
        cut = F.floor(F.col("_n") * trim)
        inside = (F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)
        center = F.avg(F.when(inside | (cut >= F.col("_n") - cut), F.col("value")))
    else:
        rows, center = long, F.avg("value") if method == "mean" else F.percentile("value", F.lit(0.5))
    out = rows.groupBy(*keys).agg(center.alias("value"), F.stddev_pop("value").alias("_s"))
    return out.select(*keys, F.greatest("value", F.lit(0.0)).alias("value"), F.greatest(F.col("value") - 1.96 * F.col("_s"), F.lit(0.0)).alias("lower"), (F.col("value") + 1.96 * F.col("_s")).alias("upper"))


def normalized(df: DataFrame, weight: Column, keys: list[str], out: str = "weight") -> DataFrame:
    """Weights that sum to 1 per key, equal where they sum to nothing."""
    rows = df.withColumn("_w", weight)
    w = W.partitionBy(*keys)
    total = F.sum("_w").over(w)
    return rows.withColumn(out, F.when(total > 0, F.col("_w") / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(w))).drop("_w")


def weights(errors: DataFrame, method: str = "inverse_error", error: str = "mape", custom: dict[str, float] | None = None, keys: list[str] = ["key"]) -> DataFrame:
    """Model weights per key: equal, custom, performance (1 / (1 + error)) or inverse error."""
    e = F.greatest(F.col(error), F.lit(1e-10))
    if method == "equal":
        w = F.lit(1.0)
    elif method == "custom":
        w = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(x))) for m, x in (custom or {}).items()], F.lit(0.0))
    elif method == "performance":
        w = 1 / (1 + e)
    else:
        w = 1 / (e + 1e-10)
    return normalized(errors, w, keys)


def weighted(long: DataFrame, model_weights: DataFrame, level: float = 0.95) -> DataFrame:
    """Weighted forecast over the members present, with a band from the mean weighted variance growing as the root of the horizon."""
    rows = long.join(model_weights.select("key", "model", "weight"), ["key", "model"])
    w, v = F.col("weight"), F.col("value")
    out = rows.groupBy("key", "date", "horizon").agg(F.try_divide(F.sum(w * v), F.sum(w)).alias("_m"), F.try_divide(F.sum(w * v * v), F.sum(w)).alias("_q"))
    variance = F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))
    out = out.withColumn("_s", F.sqrt(F.avg(variance).over(W.partitionBy("key"))))
    low, high = S.interval("_m", "horizon", "_s", level)
    return out.select("key", "date", "horizon", F.col("_m").alias("value"), low.alias("lower"), high.alias("upper"))


def stacking(long: DataFrame, actual: DataFrame, models: list[str], fit_steps: int) -> DataFrame:
    """Meta model over pivoted base forecasts, trained on the first ``fit_steps`` steps and applied to the later ones."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    wide = long.groupBy("key", "date", "horizon").pivot("model", models).agg(F.first("value")).dropna(subset=models)
    rows = VectorAssembler(inputCols=models, outputCol="features").transform(wide)
    train = rows.where(F.col("horizon") <= fit_steps).join(actual.select("key", "date", F.col("value").alias("label")), ["key", "date"])
    model = LinearRegression(regParam=0.01).fit(train.select("features", "label"))
    return model.transform(rows.where(F.col("horizon") > fit_steps)).select("key", "date", "horizon", F.greatest("prediction", F.lit(0.0)).alias("value"))


def boosting(series: DataFrame, horizon: int, frequency: str = "M", rounds: int = 4, rate: float = 0.5) -> DataFrame:
    """Rounds of weak fits on the residual with shrinkage: trend line and month mean in turn.

    A round is a pair of window aggregates over one key, so all rounds share a single shuffle by key.
    """
    rows = fc.indexed(series).withColumn("_m", F.month("date")).withColumn("_res", F.col("value"))
    line = W.partitionBy("key")
    used = []
    for i in range(rounds):
        if i % 2 == 0:
            rows = (rows.withColumn(f"_b{i}", F.coalesce(F.regr_slope("_res", "t").over(line), F.lit(0.0)))
                    .withColumn(f"_a{i}", F.avg("_res").over(line) - F.col(f"_b{i}") * F.avg("t").over(line)))
            guess = F.col(f"_a{i}") + F.col(f"_b{i}") * F.col("t")
        else:
            rows = rows.withColumn(f"_c{i}", F.avg("_res").over(W.partitionBy("key", "_m")))
            guess = F.col(f"_c{i}")
        rows = rows.withColumn("_res", F.col("_res") - rate * guess)
        used.append(i)
    lines = [i for i in used if i % 2 == 0]
    fit = rows.groupBy("key").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).cast("double").alias("n"), F.stddev_pop("_res").alias("_s"),
                                  *[F.max(f"_a{i}").alias(f"_a{i}") for i in lines], *[F.max(f"_b{i}").alias(f"_b{i}") for i in lines],
                                  *[F.map_from_entries(F.collect_set(F.struct("_m", f"_c{i}"))).alias(f"_c{i}") for i in used if i % 2])
    steps = fc.ahead(fit, horizon, frequency).withColumn("t", F.col("n") - 1 + F.col("horizon"))
    value = F.lit(0.0)
    for i in used:
        value = value + rate * (F.col(f"_a{i}") + F.col(f"_b{i}") * F.col("t") if i % 2 == 0 else F.coalesce(F.element_at(f"_c{i}", F.month("date")), F.lit(0.0)))
    return fc.long_form(steps, "boosting", value, 1.96 * F.col("_s"), None)


def bagging(series: DataFrame, horizon: int, frequency: str = "M", replicates: int = 20, share: float = 0.8, levels: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """Trend line per key and replicate on a key-hashed row sample; mean and quantile band over replicates."""
    rows = fc.indexed(series).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).where(S.key_uniform("key", "t", "rep") < share)
    whole = series.groupBy("key").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).cast("double").alias("n"))
    fit = rows.withColumn("_t", F.col("t")).groupBy("key", "rep").agg(F.regr_slope("value", "_t").alias("_b"), F.regr_intercept("value", "_t").alias("_a")).join(whole, "key")
    steps = fc.ahead(fit, horizon, frequency).withColumn("_v", F.col("_a") + F.col("_b") * (F.col("n") - 1 + F.col("horizon")))
    return steps.groupBy("key", "date", "horizon").agg(F.avg("_v").alias("value"), F.percentile("_v", F.lit(levels[0])).alias("lower"), F.percentile("_v", F.lit(levels[1])).alias("upper"), F.stddev_pop("_v").alias("std"))


def split(series: DataFrame, hold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``hold`` rows of each key are held out."""
    rows = series.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("date"))))
    return rows.where(F.col("_r") > hold).drop("_r"), rows.where(F.col("_r") <= hold).drop("_r")


def composite(mape: Column, rmse: Column, consistency: Column, direction: Column) -> Column:
    return 0.4 * F.greatest(F.lit(0.0), 1 - mape / 100) + 0.3 / (1 + rmse) + 0.2 * consistency + 0.1 * direction


def performance(long: DataFrame, test: DataFrame) -> DataFrame:
    """(key, model) error measures of forecasts on held-out rows."""
    rows = long.select("key", "date", "model", F.col("value").alias("p")).join(test.select("key", "date", F.col("value").alias("a")), ["key", "date"])
    w = W.partitionBy("key", "model").orderBy("date")
    rows = rows.withColumn("_hit", (F.signum(F.col("a") - F.lag("a").over(w)) == F.signum(F.col("p") - F.lag("p").over(w))).cast("double"))
    e = F.col("p") - F.col("a")
    out = rows.groupBy("key", "model").agg((F.avg(F.abs(F.try_divide(e, F.col("a")))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
                                           (1 / (1 + F.var_pop(e))).alias("consistency"), F.coalesce(F.avg("_hit"), F.lit(0.0)).alias("direction"))
    return out.withColumn("composite", composite(F.col("mape"), F.col("rmse"), F.col("consistency"), F.col("direction")))


def capped(df: DataFrame, keys: list[str], weight: str = "weight", trigger: float = 0.5, cap: float = 0.4) -> DataFrame:
    """Where the largest weight is above ``trigger`` every weight is cut to ``cap`` and the excess shared by the others."""
    w = W.partitionBy(*keys)
    v = F.col(weight)
    rows = df.withColumn("_hot", F.max(v).over(w) > trigger).withColumn("_x", F.sum(F.greatest(v - cap, F.lit(0.0))).over(w)).withColumn("_k", F.sum((v < cap).cast("int")).over(w))
    new = F.when(v >= cap, F.lit(cap)).otherwise(v + F.coalesce(F.try_divide(F.col("_x"), F.col("_k")), F.lit(0.0)))
    return rows.withColumn(weight, F.when(F.col("_hot"), new).otherwise(v)).drop("_hot", "_x", "_k")


def optimize(perf: DataFrame, conditions: DataFrame, method: str = "adaptive") -> DataFrame:
    """Model weights per key by method; ``adaptive`` looks at the regime of the key and spreads weights when it is hard to predict."""
    if method == "performance":
        return normalized(perf, F.col("composite"), ["key"])
    if method == "diversified":
        base = normalized(perf, F.col("composite"), ["key"], "_p")
        return normalized(base, 0.7 * F.col("_p") + 0.3 / F.count(F.lit(1)).over(W.partitionBy("key")), ["key"]).drop("_p")
    rows = perf.join(conditions.select("key", "regime", "predictability"), "key")
    raw = (F.when(F.col("regime").startswith("volatile"), 0.6 * F.col("consistency") + 0.4 * F.col("direction"))
           .otherwise(0.7 * (1 - F.col("mape") / 100) + 0.3 * (1 - F.abs("bias") / 10)))
    rows = rows.withColumn("_raw", F.greatest(raw, F.lit(0.0)))
    spread = capped(rows, ["key"], "_raw")
    spread = spread.select("key", "model", F.col("_raw").alias("_spread"))
    joined = rows.join(spread, ["key", "model"])
    chosen = F.when(F.col("predictability") < 0.3, F.col("_spread")).otherwise(F.col("_raw"))
    return normalized(joined, chosen, ["key"]).drop("_raw", "_spread")


def adapt(series: DataFrame, perf: DataFrame, old: DataFrame, version: int, lookback: int = 12) -> DataFrame:
    """Old and new weight rows of an ensemble after looking at new data, stamped with a version."""
    new = optimize(perf, rg.market_conditions(series, lookback))
    stamp = lambda df, v: df.select("key", "model", "weight", F.lit(v).alias("version"))
    return stamp(old, version - 1).unionByName(stamp(new, version))


def hybrid(series: DataFrame, horizon: int, frequency: str = "M", alpha: float = 0.3) -> DataFrame:
    """Simple smoothing plus an AR(1) on its one-step residuals, summed."""
    scanned = folds.scan_rows(series, ["key"], "date", {"l": F.lit(None).cast("double"), "e": F.lit(None).cast("double")},
                              lambda s, x: {"l": F.when(s["l"].isNull(), x["value"]).otherwise(alpha * x["value"] + (1 - alpha) * s["l"]),
                                            "e": F.when(s["l"].isNotNull(), x["value"] - s["l"])},
                              lambda s, x: {"_l": s["l"], "_e": s["e"]}, "_l double, _e double")
    p = F.lag("_e").over(W.partitionBy("key").orderBy("date"))
    both = F.col("_e").isNotNull() & F.col("_p").isNotNull()
    y, x = F.when(both, F.col("_e")), F.when(both, F.col("_p"))
    fit = scanned.withColumn("_p", p).groupBy("key").agg(F.max("date").alias("last_date"), F.max_by("_l", "date").alias("level"), F.max_by("_e", "date").alias("err"),
                                                         F.regr_slope(y, x).alias("phi"), F.regr_intercept(y, x).alias("drift"), F.stddev_pop("_e").alias("_s"))
    h = F.col("horizon")
    # phi^h e + drift (1 + phi + … + phi^(h-1)), written as a fold so that phi = 1 needs no special case.
    part = F.aggregate(F.sequence(F.lit(1), h), F.col("err"), lambda e, _: F.col("drift") + F.col("phi") * e)
    return fc.long_form(fc.ahead(fit, horizon, frequency), "hybrid", F.col("level") + F.coalesce(part, F.lit(0.0)), 1.96 * F.col("_s") * F.sqrt(h.cast("double")))
