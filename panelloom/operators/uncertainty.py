"""Uncertainty over result tables: scenario rows, forecast bands, evaluated samples. Draws come from the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, order, scalars as S, stats
from panelloom.operators.indicators import poisson_weight
from panelloom.operators.shares import SHARE, normalize
from panelloom.roles import DEFAULT, Roles

# Weights of the band methods.
METHOD_WEIGHTS = {"bootstrap": 0.4, "model": 0.3, "horizon": 0.3}


def bands(scenarios: DataFrame, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), approximate: bool = False, roles: Roles = DEFAULT) -> DataFrame:
    """Percentiles per entity-year over its scenarios as columns p5, p25, …; ``approximate`` for very many draws."""
    keys = [*roles.entity, roles.year]
    q = F.percentile_approx if approximate else F.percentile
    out = scenarios.groupBy(*keys).agg(q(roles.value, F.array(*[F.lit(p) for p in levels])).alias("_q"), F.avg(roles.value).alias("mean"), F.stddev_pop(roles.value).alias("std"))
    return out.select(*keys, "mean", "std", *[F.col("_q")[i].alias(f"p{round(p * 100):d}") for i, p in enumerate(levels)])


def totals(scenarios: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(by…, year, scenario_id, total)."""
    return scenarios.groupBy(*roles.period, "scenario_id").agg(F.sum(roles.value).alias("total"))


def statistics(sizes: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per market-year over scenarios: success rate, mean, deviation, extremes, population skewness and excess kurtosis."""
    t = F.col("total")
    return sizes.groupBy(*roles.period).agg(F.count(F.lit(1)).alias("scenarios"), (F.count(t) / F.count(F.lit(1))).alias("success_rate"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"),
                                            F.min(t).alias("low"), F.max(t).alias("high"), F.skewness(t).alias("skewness"), F.kurtosis(t).alias("kurtosis"))


def risk(sizes: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """VaR 95 and 99, CVaR 95, downside deviation and share below the mean per market-year over scenarios."""
    keys = roles.period
    cuts = order.quantiles(sizes, keys, "total", {"var_95": 0.05, "var_99": 0.01})
    means = sizes.groupBy(*keys).agg(F.avg("total").alias("_m"))
    t = F.col("total")
    rows = sizes.join(cuts.join(means, keys), keys)
    below = t < F.col("_m")
    return rows.groupBy(*keys).agg(F.max("var_95").alias("var_95"), F.max("var_99").alias("var_99"), F.avg(F.when(t <= F.col("var_95"), t)).alias("cvar_95"),
                                   F.coalesce(F.stddev_pop(F.when(below, t)), F.lit(0.0)).alias("downside_deviation"), F.avg(below.cast("double")).alias("prob_below_mean"))


def drawdown(sizes: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(by…, scenario_id, max_drawdown): largest fall of the running sum of deviations from the scenario's own mean, over time."""
    key = [*roles.by, "scenario_id"]
    w = W.partitionBy(*key).orderBy(roles.year)
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    rows = sizes.withColumn("_c", F.col("total") - F.avg("total").over(W.partitionBy(*key))).withColumn("_c", F.sum("_c").over(up_to))
    return rows.withColumn("_d", F.col("_c") - F.max("_c").over(up_to)).groupBy(*key).agg(F.min("_d").alias("max_drawdown"))


def convergence(sizes: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per market-year: recent mean against the overall mean, standard error, and relative change of the last two blocks.

    Scenario ids number the draws, so the window is a filter on the id and no rank is needed.
    """
    keys = roles.period
    n = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("scenario_id").alias("_top"))
    rows = sizes.join(n, keys).withColumn("_w", F.least(F.lit(50), F.floor(F.col("n") / 2)))
    t = F.col("total")
    recent = F.col("scenario_id") > F.col("_top") - F.col("_w")
    older = ~recent & (F.col("scenario_id") > F.col("_top") - 2 * F.col("_w"))
    out = rows.where("n >= 10").groupBy(*keys).agg(F.max("n").alias("n"), F.avg(F.when(recent, t)).alias("recent_mean"), F.avg(t).alias("overall_mean"), F.avg(F.when(older, t)).alias("_old"),
                                                   (F.stddev_pop(t) / F.sqrt(F.count(t).cast("double"))).alias("std_error"))
    gap = F.abs(F.col("recent_mean") - F.col("_old"))
    return (out.withColumn("mean_difference", F.abs(F.col("recent_mean") - F.col("overall_mean")))
            .withColumn("block_change", F.when(F.abs("_old") > 1e-10, gap / F.abs("_old")).otherwise(gap)).drop("_old"))


def scenario_concentration(scenarios: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """HHI per market-year and scenario: sum of squares over the squared sum, one pass."""
    v = F.col(roles.value)
    return scenarios.groupBy(*roles.period, "scenario_id").agg(F.coalesce(F.try_divide(F.sum(v * v), F.sum(v) * F.sum(v)) * 10000, F.lit(0.0)).alias("hhi"))


def what_if(shares: DataFrame, shocks: DataFrame, floor: float = 0.001, roles: Roles = DEFAULT) -> DataFrame:
    """Base shares under each shock row (market, scenario_id, id, shock, total): floored, rescaled, times the scenario's total."""
    keys = [*roles.period, "scenario_id"]
    rows = shares.join(shocks, roles.entity).withColumn(SHARE, F.greatest(F.col(SHARE) * (1 + F.col("shock")), F.lit(floor)))
    rows = rows.select(*keys, roles.id, SHARE, "total")
    scaled = normalize(rows, keys, SHARE, 100.0, None, roles.id)
    return scaled.withColumn(roles.value, F.col(SHARE) * F.col("total") / 100)


# ---- sensitivity ---------------------------------------------------------------------------------------------------------

def _sample_moments(samples: DataFrame, by: list[str], weight: Column) -> DataFrame:
    w = weight
    a, b, c, d = (F.col(x) for x in ("a", "b", "c", "d"))
    mean = lambda x: F.sum(w * x) / F.sum(w)
    both = (mean(a * a) + mean(b * b)) / 2 - ((mean(a) + mean(b)) / 2) * ((mean(a) + mean(b)) / 2)
    out = samples.groupBy(*by).agg(both.alias("variance"), (mean(a * c) - mean(a) * mean(c)).alias("_ac"), (mean(b * d) - mean(b) * mean(d)).alias("_bd"))
    first = F.greatest(F.lit(0.0), F.coalesce(F.try_divide("_ac", "variance"), F.lit(0.0)))
    total = S.clip(1 - F.coalesce(F.try_divide("_bd", "variance"), F.lit(1.0)), 0.0, 1.0)
    return out.select(*by, first.alias("first_order"), total.alias("total_order"))


def sensitivity(samples: DataFrame) -> DataFrame:
    """First, total and interaction index, ranks and class per parameter.

    ``samples(sample_id, parameter, a, b, c, d)``: outputs on the A and B samples, on C (shares only this parameter with A) and D
    (shares all but this parameter with B). Parameters are few, so ranks are windows over the result.
    """
    out = _sample_moments(samples, ["parameter"], F.lit(1.0)).withColumn("interaction", F.greatest(F.lit(0.0), F.col("total_order") - F.col("first_order")))
    label = S.bands("total_order", [(0.1, "high"), (0.05, "medium"), (0.01, "low")], "negligible", strict=True)
    return (out.withColumn("total_rank", F.row_number().over(W.orderBy(F.desc("total_order"), "parameter")))
            .withColumn("first_rank", F.row_number().over(W.orderBy(F.desc("first_order"), "parameter"))).withColumn("importance", label))


def pair_interaction(indices: DataFrame) -> DataFrame:
    """(first, second, interaction): lower of both parameters' own interaction, for each pair of the few parameters."""
    one = indices.select(F.collect_list(F.struct("parameter", "interaction")).alias("_l"))
    pairs = one.select(F.explode("_l").alias("x"), "_l").select("x", F.explode("_l").alias("y")).where(F.col("x.parameter") < F.col("y.parameter"))
    return pairs.select(F.col("x.parameter").alias("first"), F.col("y.parameter").alias("second"), F.least("x.interaction", "y.interaction").alias("interaction"))


def variance_explained(indices: DataFrame) -> DataFrame:
    main = F.sum("first_order")
    return indices.agg(main.alias("main_effects"), F.greatest(F.lit(0.0), 1 - main).alias("interaction_effects"))


def sensitivity_intervals(samples: DataFrame, replicates: int = 50, level: float = 0.95) -> DataFrame:
    """Percentile intervals of both indices over key-hashed Poisson replicates of the samples."""
    rows = samples.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("_w", poisson_weight(S.key_uniform("sample_id", "rep")).cast("double"))
    reps = _sample_moments(rows, ["parameter", "rep"], F.col("_w"))
    lo, hi = F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2)
    return reps.groupBy("parameter").agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in ("first_order", "total_order") for n, q in (("lower", lo), ("upper", hi))])


# ---- dependence ------------------------------------------------------------------------------------------------------------

def uniform_margins(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Average rank over (n + 1) of both columns inside each group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = order.with_ranks(order.with_ranks(rows, by, F.col(x), average="_rx", size="_n"), by, F.col(y), average="_ry")
    return ranked.withColumn("u", F.col("_rx") / (F.col("_n") + 1)).withColumn("v", F.col("_ry") / (F.col("_n") + 1)).drop("_rx", "_ry", "_n")


def dependence(df: DataFrame, by: list[str], x: str, y: str, tail: float = 0.05) -> DataFrame:
    """Pearson, Spearman, Kendall, upper and lower tail dependence, and copula parameters implied by tau."""
    u = uniform_margins(df, by, x, y)
    up, low = F.col("u") > 1 - tail, F.col("u") < tail
    base = u.groupBy(*by).agg(S.corr(x, y).alias("pearson"), S.corr("u", "v").alias("spearman"),
                              F.coalesce(F.try_divide(F.count_if(up & (F.col("v") > 1 - tail)), F.count_if(up)), F.lit(0.0)).alias("upper_tail"),
                              F.coalesce(F.try_divide(F.count_if(low & (F.col("v") < tail)), F.count_if(low)), F.lit(0.0)).alias("lower_tail"))
    tau = F.col("kendall")
    out = base.join(stats.kendall(df, by, x, y), by)
    return (out.withColumn("clayton", F.when(tau > 0, F.greatest(F.try_divide(2 * tau, 1 - tau), F.lit(1e-6))).otherwise(F.lit(1e-6)))
            .withColumn("gumbel", F.when(tau > 0, F.greatest(F.try_divide(F.lit(1.0), 1 - tau), F.lit(1.001))).otherwise(F.lit(1.001)))
            .withColumn("frank", F.when(F.abs(tau) < 0.99, F.try_divide(4 * tau, 1 - tau)).otherwise(F.lit(2.0))))


def variance_split(df: DataFrame, by: list[str], model: str = "model", value: str = "value") -> DataFrame:
    """Total, between-model and within-model variance and their ratios, exactly, from two levels of aggregates."""
    v = F.col(value)
    per = df.groupBy(*by, model).agg(F.count(v).cast("double").alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"))
    n = F.sum("_n")
    grand = F.sum(F.col("_n") * F.col("_m")) / n
    out = per.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_v")) / n).alias("within"), (F.sum(F.col("_n") * F.col("_m") * F.col("_m")) / n - grand * grand).alias("between"))
    out = out.withColumn("between", F.greatest("between", F.lit(0.0))).withColumn("total", F.col("within") + F.col("between"))
    return out.withColumn("between_ratio", F.try_divide("between", "total")).withColumn("within_ratio", F.try_divide("within", "total"))


def entropy(df: DataFrame, by: list[str], value: str, most_bins: int = 50) -> DataFrame:
    """Differential entropy of a histogram with at most ``most_bins`` (root of n) bins."""
    edges = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count(value).alias("_n"))
    rows = df.join(edges, by).withColumn("_k", F.least(F.lit(most_bins), F.floor(F.sqrt(F.col("_n").cast("double"))).cast("int")))
    bins = rows.select(*by, "_a", "_b", "_n", "_k", stats.histogram_bin(F.col(value), F.col("_a"), F.col("_b"), F.col("_k")).alias("_bin")).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"), F.max((F.col("_b") - F.col("_a")) / F.col("_k")).alias("_w"))
    p = F.col("_c") / F.col("_n")
    return bins.where("_w > 0").groupBy(*by).agg((-F.sum(p * F.log(p / F.col("_w")))).alias("entropy"), F.count(F.lit(1)).alias("filled_bins"))


def mutual_information(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Mutual information of two columns over root-of-n bins each."""
    edges = df.groupBy(*by).agg(F.min(x).alias("_xa"), F.max(x).alias("_xb"), F.min(y).alias("_ya"), F.max(y).alias("_yb"), F.floor(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("int").alias("_k"))
    rows = df.join(edges, by)
    binned = rows.select(*by, stats.histogram_bin(F.col(x), F.col("_xa"), F.col("_xb"), F.col("_k")).alias("_bx"), stats.histogram_bin(F.col(y), F.col("_ya"), F.col("_yb"), F.col("_k")).alias("_by"), F.lit(1).alias("_n"))
    return stats.mutual_information(binned, by, "_bx", "_by")


# ---- bands ---------------------------------------------------------------------------------------------------------------

def model_spread(long: DataFrame) -> DataFrame:
    """Mean, deviation, range and agreement of the models per key and date."""
    v = F.col("value")
    out = long.groupBy("key", "date", "horizon").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    return out.withColumn("range", F.col("high") - F.col("low")).withColumn("agreement", 1 - F.try_divide("std", "mean"))


def horizon_band(df: DataFrame, value: str, std: str, volatility: str | None = None, method: str = "sqrt_time", level: float = 0.95) -> DataFrame:
    """Adds lower, upper and std growing with the horizon (sqrt_time, linear, exponential), scaled by volatility where given."""
    h = F.col("horizon").cast("double")
    scale = {"sqrt_time": F.sqrt(h), "linear": h, "exponential": F.exp(h * 0.1)}[method]
    if volatility is not None:
        scale = scale * (1 + F.coalesce(F.col(volatility), F.lit(0.0)) * h * 0.1)
    margin = S.z_value(level) * F.col(std) * scale
    return df.withColumn("lower", F.col(value) - margin).withColumn("upper", F.col(value) + margin).withColumn("band_std", F.col(std) * scale)


def combine_bands(methods: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One band per key and step from ``methods(key, date, horizon, method, value, lower, upper)``; its deviation never shrinks: a
    smaller one becomes 1.05 times the one before."""
    weights = weights or METHOD_WEIGHTS
    w = None
    for name, x in weights.items():
        w = F.when(F.col("method") == name, F.lit(float(x))) if w is None else w.when(F.col("method") == name, F.lit(float(x)))
    rows = methods.withColumn("_w", w.otherwise(F.lit(0.0)))
    mixed = rows.groupBy("key", "date", "horizon").agg(F.max("value").alias("value"), F.try_divide(F.sum(F.col("_w") * F.col("lower")), F.sum("_w")).alias("_l"), F.try_divide(F.sum(F.col("_w") * F.col("upper")), F.sum("_w")).alias("_u"))
    mixed = mixed.withColumn("_l", F.coalesce("_l", F.col("value") * 0.8)).withColumn("_u", F.coalesce("_u", F.col("value") * 1.2)).withColumn("_s", (F.col("_u") - F.col("_l")) / (2 * 1.96))

    def step(s: Column, x: Column) -> dict[str, Column]:
        return {"s": F.when(x["_s"] < s["s"], s["s"] * 1.05).otherwise(x["_s"])}

    out = folds.scan_rows(mixed, ["key"], "horizon", {"s": F.lit(None).cast("double")}, step, lambda s, x: {"std": s["s"]}, "std double")
    grown = F.col("std") > F.col("_s")
    return out.select("key", "date", "horizon", "value", F.when(grown, F.col("value") - 1.96 * F.col("std")).otherwise(F.col("_l")).alias("lower"),
                      F.when(grown, F.col("value") + 1.96 * F.col("std")).otherwise(F.col("_u")).alias("upper"), "std")


def control_variate(df: DataFrame, by: list[str], target: str, control: str, expectation: str) -> DataFrame:
    """Estimate corrected by a control column with known expectation, and the variance reduction factor."""
    t, c = F.col(target), F.col(control)
    out = df.groupBy(*by).agg(F.avg(t).alias("plain"), F.avg(c).alias("_c"), F.covar_samp(t, c).alias("_tc"), F.var_pop(c).alias("_vc"), F.first(expectation).alias("_e"), S.corr(t, c).alias("_r"))
    factor = F.coalesce(F.try_divide(-F.col("_tc"), F.col("_vc")), F.lit(0.0))
    left = 1 - F.coalesce(F.col("_r"), F.lit(0.0)) * F.coalesce(F.col("_r"), F.lit(0.0))
    return out.select(*by, "plain", (F.col("plain") + factor * (F.col("_c") - F.col("_e"))).alias("estimate"), F.when(left > 0, 1 / left).otherwise(F.lit(1.0)).alias("reduction"))


def stratified(df: DataFrame, by: list[str], stratum: str, value: str) -> DataFrame:
    """Mean and its variance over strata weighted by their size."""
    per = df.groupBy(*by, stratum).agg(F.count(value).cast("double").alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    n = F.sum("_n")
    return per.groupBy(*by).agg((F.sum(F.col("_n") * F.col("_m")) / n).alias("mean"), (F.sum(F.col("_n") * F.coalesce("_v", F.lit(0.0))) / (n * n)).alias("variance"), F.count(F.lit(1)).alias("strata"))


def posterior_summary(samples: DataFrame, prior: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Credible interval, mean and variance of each parameter's samples, and how much of the prior variance is gone."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    out = samples.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.percentile("value", F.lit(lo)).alias("lower"), F.percentile("value", F.lit(hi)).alias("upper"), F.count("value").alias("n"))
    joined = out.join(prior.select(*by, "prior_variance"), by, "left")
    return joined.withColumn("reduction", F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide("variance", "prior_variance"), F.lit(0.0)))).withColumn("predictive_variance", F.col("variance") * (1 + 1 / F.col("n")))


def diagnose(history: DataFrame, by: list[str], step: str, measure: str, threshold: float = 0.01, last: int = 5) -> DataFrame:
    """Slope class, stability class and recommendation over the last convergence checks."""
    w = W.partitionBy(*by).orderBy(F.desc(step))
    rows = history.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by))).where(F.col("_r") <= last)
    m = F.col(measure)
    out = rows.groupBy(*by).agg(F.max("_n").alias("checks"), F.regr_slope(m, -F.col("_r").cast("double")).alias("slope"), F.var_pop(m).alias("_v"), F.max(F.when(F.col("_r") == 1, m)).alias("final"))
    trend = F.when(F.col("checks") < 3, "insufficient_data").when(F.col("slope") < -0.001, "improving").when(F.col("slope") > 0.001, "deteriorating").otherwise("stable")
    steady = F.when(F.col("checks") < 5, "unknown").when(F.col("_v") < threshold / 10, "very_stable").when(F.col("_v") < threshold / 2, "stable").otherwise("unstable")
    out = out.withColumn("trend", trend).withColumn("stability", steady).withColumn("converged", F.col("final") < threshold)
    advice = (F.when(F.col("converged") & F.col("stability").isin("stable", "very_stable"), "can_stop").when(F.col("trend") == "improving", "continue_brief")
              .when(F.col("trend") == "deteriorating", "increase_samples").otherwise("continue_monitoring"))
    return out.withColumn("recommendation", advice).drop("_v")
