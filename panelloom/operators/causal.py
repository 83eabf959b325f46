"""Causal and intervention analysis over panels and keyed series."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions.session import with_row
from panelloom.functions import folds, scalars as S, stats
from panelloom.operators import indicators as ind
from panelloom.roles import DEFAULT, Roles


def pair_correlations(panel: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, correlation, n) for every pair of columns from a single aggregate over the panel."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), S.corr(a, b).alias("correlation"), F.count(F.when(F.col(a).isNotNull(), F.col(b))).alias("n"))
             for a, b in combinations(names, 2)]
    return panel.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def skeleton(panel: DataFrame, names: list[str], alpha: float = 0.05, minimum: float = 0.1) -> DataFrame:
    """Undirected edges: significant pairs with |r| above the minimum."""
    rows = pair_correlations(panel, names)
    rows = rows.withColumn("p_value", stats.p_value(stats.correlation_t(F.col("correlation"), F.col("n")), F.col("n") - 2))
    return rows.where((F.col("p_value") < alpha) & (F.abs("correlation") > minimum)).withColumn("weight", F.abs("correlation"))


def directed_edges(panel: DataFrame, names: list[str], minimum: float = 0.3) -> DataFrame:
    """Both directions of every pair with |r| above the minimum."""
    rows = pair_correlations(panel, names).where(F.abs("correlation") > minimum).withColumn("weight", F.abs("correlation"))
    return rows.select("a", "b", "weight").unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def partial_effect(panel: DataFrame, treatment: str, outcome: str, confounders: list[str], row_keys: list[str], folds_: int = 2, replicates: int = 20) -> DataFrame:
    """Slope of outcome residual on treatment residual, both cross-fitted on the confounders, with a bootstrap interval."""
    from functools import reduce
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from panelloom.functions.session import cut_lineage
    rows = VectorAssembler(inputCols=confounders, outputCol="features").transform(panel.dropna(subset=[treatment, outcome, *confounders]))
    rows = cut_lineage(rows.withColumn("_f", F.floor(S.key_uniform(*row_keys) * folds_).cast("int")))
    parts = []
    for f in range(folds_):
        out = rows.where(F.col("_f") == f)
        for c, res in ((treatment, "_t"), (outcome, "_y")):
            model = LinearRegression(labelCol=c, predictionCol=f"_p{res}").fit(rows.where(F.col("_f") != f))
            out = model.transform(out).withColumn(res, F.col(c) - F.col(f"_p{res}"))
        parts.append(out.select(*row_keys, "_t", "_y"))
    both = cut_lineage(reduce(DataFrame.unionByName, parts))
    fit = both.agg(F.regr_slope("_y", "_t").alias("effect"), S.corr("_y", "_t").alias("correlation"), F.count(F.lit(1)).alias("n"))
    reps = both.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", ind.poisson_weight(S.key_uniform(*row_keys, "rep")).cast("double"))
    w, t, y = F.col("_w"), F.col("_t"), F.col("_y")
    slopes = reps.groupBy("rep").agg(F.try_divide(F.sum(w) * F.sum(w * t * y) - F.sum(w * t) * F.sum(w * y), F.sum(w) * F.sum(w * t * t) - F.sum(w * t) * F.sum(w * t)).alias("_s"))
    band = slopes.agg(F.percentile("_s", F.lit(0.025)).alias("lower"), F.percentile("_s", F.lit(0.975)).alias("upper"))
    return fit.transform(with_row, band).withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))


def nonlinear_gain(panel: DataFrame, features: list[str], outcome: str, degree: int = 2) -> DataFrame:
    """R2 of a linear fit against an L1 fit on polynomial features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rows = panel.dropna(subset=[*features, outcome])
    start = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True)]
    plain = Pipeline(stages=[*start, LinearRegression(featuresCol="_std", labelCol=outcome)]).fit(rows).stages[-1].summary.r2
    wide = Pipeline(stages=[*start, PolynomialExpansion(degree=degree, inputCol="_std", outputCol="_poly"),
                            LinearRegression(featuresCol="_poly", labelCol=outcome, elasticNetParam=1.0, regParam=0.01)]).fit(rows).stages[-1].summary.r2
    return panel.sparkSession.createDataFrame([(float(plain), float(wide), float(wide - plain))], "linear_r2 double, polynomial_r2 double, gain double")


def forest_benefit(panel: DataFrame, features: list[str], outcome: str, folds_: int = 5, seed: int = 7) -> DataFrame:
    """Cross-validated R2 of a forest minus that of a line."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from panelloom.functions.session import cut_lineage
    rows = cut_lineage(VectorAssembler(inputCols=features, outputCol="features").transform(panel.dropna(subset=[*features, outcome])).select("features", outcome))
    score = RegressionEvaluator(labelCol=outcome, metricName="r2")
    out = {}
    for name, model in (("linear", LinearRegression(labelCol=outcome)), ("forest", RandomForestRegressor(labelCol=outcome, numTrees=10, maxDepth=4, seed=seed))):
        out[name] = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=score, numFolds=folds_, seed=seed).fit(rows).avgMetrics[0]
    return panel.sparkSession.createDataFrame([(float(out["linear"]), float(out["forest"]), float(out["forest"] - out["linear"]))], "linear_r2 double, forest_r2 double, benefit double")


def cusum(series: DataFrame, drift: float = 0.5, threshold: float = 2.0) -> DataFrame:
    """Adds upper and lower cumulative sums of the standardised series and ``is_change``; a constant series has none."""
    whole = W.partitionBy("key")
    rows = series.withColumn("_z", F.try_divide(F.col("value") - F.avg("value").over(whole), F.stddev_samp("value").over(whole)))

    def step(s: Column, x: Column) -> dict[str, Column]:
        z = F.coalesce(x["_z"], F.lit(0.0))
        first = s["n"] == 0
        return {"n": s["n"] + 1, "up": F.when(first, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), s["up"] + z - drift)),
                "down": F.when(first, F.lit(0.0)).otherwise(F.least(F.lit(0.0), s["down"] + z + drift))}

    out = folds.scan_rows(rows, ["key"], "date", {"n": F.lit(0), "up": F.lit(0.0), "down": F.lit(0.0)}, step, lambda s, x: {"upper": s["up"], "lower": s["down"]}, "upper double, lower double")
    known = F.col("_z").isNotNull()
    return out.withColumn("is_change", known & ((F.abs("upper") > threshold) | (F.abs("lower") > threshold))).drop("_z")


def peaks(series: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Rows whose absolute step is a local maximum at or above the key's own quantile of steps."""
    w = W.partitionBy("key").orderBy("date")
    rows = series.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    limits = rows.groupBy("key").agg(F.percentile("step", F.lit(quantile)).alias("_q"))
    near = rows.withColumn("_a", F.lag("step").over(w)).withColumn("_b", F.lead("step").over(w))
    return near.join(limits, "key").where((F.col("step") > F.col("_a")) & (F.col("step") > F.col("_b")) & (F.col("step") >= F.col("_q"))).select("key", "date", "value", "step")


def variance_changes(series: DataFrame, window: int = 10, quantile: float = 0.9) -> DataFrame:
    """Rows where the rolling variance moves by more than the key's own quantile of such moves; needs two windows of rows."""
    w = W.partitionBy("key").orderBy("date")
    frame = w.rowsBetween(-(window - 1), 0)
    rows = series.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("key"))).withColumn("_v", F.when(F.count("value").over(frame) == window, F.var_samp("value").over(frame)))
    rows = rows.withColumn("move", F.abs(F.col("_v") - F.lag("_v").over(w))).where(F.col("_n") >= 2 * window)
    limits = rows.groupBy("key").agg(F.percentile("move", F.lit(quantile)).alias("_q"))
    return rows.join(limits, "key").where(F.col("move") > F.col("_q")).select("key", "date", "value", "move")


def synthetic_control(df: DataFrame, treated: int, start: int, roles: Roles = DEFAULT) -> dict[str, DataFrame]:
    """Controls weighted by inverse distance to the treated entity before ``start``: weights, path and effect per market.

    The treated series has one row per market-year; controls join to it on that key, so no pairs of entities arise.
    """
    y, v, keys = roles.year, roles.value, list(roles.by)
    unit = df.where(F.col(roles.id) == treated).select(*roles.period, F.col(v).alias("treated"))
    controls = df.where(F.col(roles.id) != treated).select(*roles.entity, y, F.col(v).alias("_c")).join(unit, roles.period)
    before = F.col(y) < start
    gaps = controls.where(before).groupBy(*roles.entity).agg(F.avg((F.col("_c") - F.col("treated")) * (F.col("_c") - F.col("treated"))).alias("distance"))
    raw = gaps.withColumn("_w", 1 / (F.sqrt("distance") + 1e-8))
    totals = raw.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    weights = (raw.join(totals, keys) if keys else raw.transform(with_row, totals)).withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_t")
    path = (controls.join(weights, roles.entity).groupBy(*roles.period).agg(F.max("treated").alias("treated"), F.try_divide(F.sum(F.col("weight") * F.col("_c")), F.sum("weight")).alias("synthetic"))
            .withColumn("effect", F.col("treated") - F.col("synthetic")))
    e = F.col("effect")
    pre = F.when(before, F.col("treated"))
    effect = path.groupBy(*keys).agg(F.avg(F.when(~before, e)).alias("average_effect"), F.sum(F.when(~before, e)).alias("cumulative_effect"),
                                     (1 - F.try_divide(F.sum(F.when(before, e * e)), F.var_pop(pre) * F.count(pre))).alias("pre_r2"))
    return {"weights": weights, "path": path, "effect": effect}


def variance_regimes(df: DataFrame, target: str, others: list[str], key: str = "key", order_by: str = "date", window: int = 6) -> DataFrame:
    """(regime, n, mean, variance, correlations): rows split at the median of their key's rolling variance, joined on the row itself."""
    frame = W.partitionBy(key).orderBy(order_by).rowsBetween(-(window - 1), 0)
    rows = df.withColumn("_v", F.when(F.count(target).over(frame) == window, F.var_samp(target).over(frame))).where(F.col("_v").isNotNull())
    limits = rows.groupBy(key).agg(F.percentile("_v", F.lit(0.5)).alias("_q"))
    split = rows.join(limits, key).withColumn("regime", (F.col("_v") > F.col("_q")).cast("int"))
    return split.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.var_samp(target).alias("variance"),
                                       *[F.coalesce(S.corr(c, target), F.lit(0.0)).alias(f"corr_{c}") for c in others]).where("n >= 10")


def composite_strength(evidence: DataFrame) -> DataFrame:
    """Adds ``strength`` in 0..1 from discovery, effect, nonlinearity, intervention and stability columns."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    total = ((c("pc_weight") + c("order_weight")) / 2 * 0.2 + F.when(F.col("significant"), F.abs(c("effect")) * 0.3).otherwise(0.0) + F.greatest(c("nonlinear_gain"), c("kernel_benefit")) * 0.2
             + F.when(c("interventions") > 0, F.abs(c("intervention_effect")) * 0.15).otherwise(0.0) + F.when(c("significant_periods") > 0, c("effect_stability") * 0.15).otherwise(0.0))
    return evidence.withColumn("strength", S.clip(total, 0.0, 1.0))


def enhanced_weights(base: DataFrame, strengths: DataFrame) -> DataFrame:
    """0.3 base + 0.7 causal strength, normalised (indicator tables are definition-sized)."""
    rows = base.join(strengths.select("indicator", "strength"), "indicator", "left").withColumn("_w", 0.3 * F.col("weight") + 0.7 * F.coalesce("strength", F.lit(0.0)))
    return rows.select("indicator", F.try_divide(F.col("_w"), F.sum("_w").over(W.partitionBy())).alias("weight"))


def adjust_shares(shares: DataFrame, values: DataFrame, base: DataFrame, strengths: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return ind.adjust_shares(shares, ind.entity_scores(values, enhanced_weights(base, strengths), [roles.id], roles.year), roles)


def analysis(panel: DataFrame, names: list[str], outcome: str, row_keys: list[str], switches: tuple[str, ...] = ("discovery", "effects", "nonlinear")) -> dict[str, DataFrame]:
    """The parts asked for: discovery edges, partial effect of the first name given the others, nonlinearity."""
    out: dict[str, DataFrame] = {}
    if "discovery" in switches:
        out["edges"] = skeleton(panel, [*names, outcome])
    if "effects" in switches:
        out["effect"] = partial_effect(panel, names[0], outcome, names[1:], row_keys)
    if "nonlinear" in switches:
        out["nonlinear"] = nonlinear_gain(panel, names, outcome)
    return out
