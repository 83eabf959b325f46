"""Forecast accuracy and calibration. Input rows carry ``actual`` and ``forecast``; ``by`` may name the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import order, scalars as S
from panelloom.functions.session import calendar_side, with_row
from panelloom.operators.shares import SHARE
from panelloom.roles import DEFAULT, CalibrationSettings, Roles


def actual() -> Column:
    return F.col("actual")


def predicted() -> Column:
    return F.col("forecast")


# Weight of each metric in the confidence score and the value at which its score reaches 0.
SCORE_WEIGHTS = {"mape": 0.4, "r2": 0.4, "rmse": 0.1, "bias": 0.1}
SCORE_LIMITS = {"mape": 50.0, "rmse": 1000.0, "bias": 25.0}
# Calibration approach by confidence, and its adjustment.
APPROACHES = [(0.85, "conservative"), (0.7, "moderate"), (0.5, "aggressive")]
APPROACH_FACTORS = {"conservative": 0.05, "moderate": 0.1, "aggressive": 0.2, "very_aggressive": 0.3}
# Starting component weights.
COMPONENT_WEIGHTS = {"tier_classification": 0.2, "causal_integration": 0.2, "gradient_harmonization": 0.15,
                     "distribution_method": 0.3, "regional_aggregation": 0.15}


def r_squared() -> Column:
    """1 - SSE / SST; 1 or 0 where the actual values do not vary."""
    sse, sst = F.sum((actual() - predicted()) * (actual() - predicted())), F.var_pop(actual()) * F.count(actual())
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def backtest(df: DataFrame, periods: tuple[int, ...] = (1, 3, 5), roles: Roles = DEFAULT) -> DataFrame:
    """(by…, period, entity metrics) over the last ``period`` years of each market for entities with two years or more."""
    last = df.groupBy(*roles.by).agg(F.max(roles.year).alias("_last"))
    joined = df.join(last, list(roles.by)) if roles.by else df.transform(with_row, last)
    rows = joined.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods]))).where(F.col(roles.year) > F.col("_last") - F.col("period"))
    out = rows.where(actual().isNotNull() & predicted().isNotNull()).groupBy(*roles.by, "period", roles.id).agg(
        (F.avg(F.try_divide(F.abs(actual() - predicted()), F.abs(actual()))) * 100).alias("mape"), F.sqrt(F.avg((actual() - predicted()) * (actual() - predicted()))).alias("rmse"), r_squared().alias("r2"),
        F.avg(F.coalesce(F.try_divide(predicted() - actual(), actual()), F.lit(0.0)) * 100).alias("bias"), F.count(F.lit(1)).alias("n"), F.sum(actual()).alias("_sum"), F.avg(predicted()).alias("weight"))
    return out.where("n >= 2 and _sum > 0").drop("_sum")


def period_summary(entities: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per period: value-weighted mean MAPE, RMSE and bias, median R2, number of entities."""
    keys = [*roles.by, "period"]
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))
    means = entities.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(m) * w), F.sum(w)).alias(m) for m in ("mape", "rmse", "bias")], F.count(F.lit(1)).alias("entities"))
    return means.join(order.quantiles(entities, keys, "r2", {"r2": 0.5}), keys)


def overall(summary: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return summary.groupBy(*roles.by).agg(*[F.avg(m).alias(m) for m in ("mape", "rmse", "bias", "r2")])


def series_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, MAPE over non-zero actuals, RMSE, Theil U."""
    mse = F.avg((actual() - predicted()) * (actual() - predicted()))
    return df.groupBy(*keys).agg(F.avg(F.abs(actual() - predicted())).alias("mae"), (F.avg(F.abs(F.try_divide(actual() - predicted(), actual()))) * 100).alias("mape"), F.sqrt(mse).alias("rmse"),
                                 F.try_divide(F.sqrt(mse), F.sqrt(F.avg(actual() * actual()) + F.avg(predicted() * predicted()))).alias("theil_u"))


def extended_metrics(df: DataFrame, keys: list[str], entity: list[str], year: str = "year") -> DataFrame:
    """R2, direction hit rate, bias in %, and Theil U against the naive forecast. Steps are taken inside an entity."""
    w = W.partitionBy(*entity).orderBy(year)
    rows = df.withColumn("_a", F.lag("actual").over(w)).withColumn("_p", F.lag("forecast").over(w))
    moved = F.col("_a").isNotNull() & F.col("_p").isNotNull()
    hit = F.when(moved, ((actual() > F.col("_a")) == (predicted() > F.col("_p"))).cast("double"))
    sq = lambda c: F.when(moved, c * c)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(actual() - predicted())).alias("mae"), F.sqrt(F.avg((actual() - predicted()) * (actual() - predicted()))).alias("rmse"),
        (F.avg(F.abs((actual() - predicted()) / F.greatest(actual(), F.lit(1e-10)))) * 100).alias("mape"), r_squared().alias("r2"),
        (F.coalesce(F.avg(hit), F.lit(0.0)) * 100).alias("direction"), F.avg(predicted() - actual()).alias("bias"),
        F.coalesce(F.try_divide(F.avg(predicted() - actual()), F.avg(actual())) * 100, F.lit(0.0)).alias("bias_pct"),
        F.sqrt(F.try_divide(F.avg(sq(predicted() - actual())), F.avg(sq(F.col("_a") - actual())))).alias("theil_u"))


def horizon_table(df: DataFrame, model: str = "model", horizon: str = "horizon") -> DataFrame:
    return series_metrics(df, [model, horizon])


def model_comparison(df: DataFrame, model: str = "model") -> DataFrame:
    """Metrics per model with its rank by MAPE (models are few)."""
    return series_metrics(df, [model]).withColumn("rank", F.row_number().over(W.orderBy("mape", model)))


def residual_table(df: DataFrame, half_width: float = 0.1) -> DataFrame:
    res = actual() - predicted()
    return (df.withColumn("residual", res).withColumn("residual_pct", F.try_divide(res, actual()) * 100)
            .withColumn("in_band", F.abs(res) <= F.abs(predicted()) * half_width))


def coverage(df: DataFrame, keys: list[str], half_widths: tuple[float, ...] = (0.05, 0.1, 0.2, 0.4)) -> DataFrame:
    """Share of actual values inside a band of each relative half width."""
    rows = df.withColumn("half_width", F.explode(F.array(*[F.lit(h) for h in half_widths])))
    return rows.groupBy(*keys, "half_width").agg(F.avg((F.abs(actual() - predicted()) <= F.abs(predicted()) * F.col("half_width")).cast("double")).alias("coverage"))


def confidence_score(metrics: DataFrame) -> DataFrame:
    """Adds ``confidence`` in 0..1 from the metrics present, and the calibration ``approach``."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for m, w in SCORE_WEIGHTS.items():
        c = F.col(m)
        raw = c if m == "r2" else 1 - F.abs(c) / SCORE_LIMITS[m] if m == "bias" else 1 - c / SCORE_LIMITS[m]
        total += F.coalesce(S.clip(raw, 0.0, 1.0) * w, F.lit(0.0))
        weight += F.when(c.isNotNull(), w).otherwise(0.0)
    return (metrics.withColumn("confidence", F.coalesce(F.try_divide(total, weight), F.lit(0.5)))
            .withColumn("approach", S.bands("confidence", APPROACHES, "very_aggressive")))


def approach_factor(approach: Column | str) -> Column:
    approach = S.col(approach)
    out = None
    for name, f in APPROACH_FACTORS.items():
        out = F.when(approach == name, f) if out is None else out.when(approach == name, f)
    return out.otherwise(0.1)


def entity_adjustments(entities: DataFrame, scores: DataFrame, settings: CalibrationSettings = CalibrationSettings(), roles: Roles = DEFAULT) -> DataFrame:
    """The worst entities (mean MAPE above the gate) with strength and growth correction from their mean bias."""
    keys = list(roles.by)
    means = entities.groupBy(*keys, roles.id).agg(F.avg("mape").alias("mape"), F.avg("bias").alias("bias")).where(F.col("mape") > settings.mape_gate)
    worst = means.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("mape"), roles.id))).where(F.col("rank") <= settings.top_entities)
    joined = worst.join(scores.select(*keys, "approach"), keys) if keys else worst.transform(with_row, scores.select("approach"))
    return (joined.withColumn("strength", F.least(F.lit(0.5), F.col("mape") / 100) * approach_factor("approach"))
            .withColumn("growth_adjustment", -F.col("bias") / 100 * F.col("strength")))


def apply_calibration(df: DataFrame, bias: DataFrame, forecast_from: int, settings: CalibrationSettings = CalibrationSettings(), roles: Roles = DEFAULT) -> DataFrame:
    """Half of a large bias taken out of forecast years, shares back to 100, values recomputed from each year's total."""
    b = F.coalesce("_bias", F.lit(0.0))
    gate = (F.abs(b) > settings.bias_gate) & (F.col(roles.year) >= forecast_from)
    factor = F.when(gate, 1 - b / 100 * settings.bias_share).otherwise(F.lit(1.0))
    moved = (df.join(bias.select(*roles.entity, F.col("bias").alias("_bias")), roles.entity, "left")
             .withColumn(roles.value, F.col(roles.value) * factor).withColumn(SHARE, F.col(SHARE) * factor).select(*df.columns))
    sums = moved.groupBy(*roles.period).agg(F.sum(roles.value).alias("_t"), F.sum(SHARE).alias("_s"))
    return (moved.join(calendar_side(sums, roles.by), roles.period)
            .withColumn(SHARE, F.when(F.col("_s") > 0, F.col(SHARE) / F.col("_s") * 100).otherwise(F.col(SHARE)))
            .withColumn(roles.value, F.col(SHARE) * F.col("_t") / 100).select(*df.columns))


def tier_impact(entities: DataFrame, tiers: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(by…, impact): how far mean MAPE differs between tiers, as spread over mean, in 0..1."""
    means = entities.join(tiers.select(*roles.entity, "tier"), roles.entity).groupBy(*roles.by, "tier").agg(F.avg("mape").alias("m"))
    return means.groupBy(*roles.by).agg(S.clip(F.coalesce(F.try_divide(F.max("m") - F.min("m"), F.avg("m")), F.lit(0.0)), 0.0, 1.0).alias("impact"))


def update_weights(components: DataFrame, rate: float = 0.15, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """New component weights by a logistic response to 1 - impact, kept in 0.05..0.5, then normalised."""
    performance = S.clip(1 - F.col("impact"), 0.0, 1.0)
    move = (1 / (1 + F.exp(-10 * (performance - 0.5))) - 0.5) * 2 * rate
    raw = components.withColumn("change", move).withColumn("new_weight", S.clip(F.col("weight") * (1 + F.col("change")), 0.05, 0.5))
    return raw.withColumn("normalized", F.col("new_weight") / F.sum("new_weight").over(W.partitionBy(*keys)))


def update_parameters(parameters: DataFrame, impact_gate: float = 0.6) -> DataFrame:
    """``new_value`` = value moved by the approach's factor in its ``direction`` where the impact passes the gate."""
    move = F.when(F.col("impact") > impact_gate, approach_factor("approach") * F.col("direction")).otherwise(F.lit(0.0))
    return parameters.withColumn("new_value", F.col("value") * (1 + move))


def error_tables(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Errors over all rows, and MAPE per entity."""
    whole = df.agg((F.avg(F.abs(F.try_divide(actual() - predicted(), actual()))) * 100).alias("mape"), F.sqrt(F.avg((actual() - predicted()) * (actual() - predicted()))).alias("rmse"), F.avg(F.abs(actual() - predicted())).alias("mae"),
                   F.avg(predicted() - actual()).alias("bias"), r_squared().alias("r2"))
    return whole, df.groupBy(entity).agg((F.avg(F.abs(F.try_divide(actual() - predicted(), actual()))) * 100).alias("mape"))


def calibration_report(df: DataFrame, tiers: DataFrame, settings: CalibrationSettings = CalibrationSettings(), roles: Roles = DEFAULT) -> dict[str, DataFrame]:
    """All parts of one calibration run as tables."""
    entities = backtest(df, settings.periods, roles)
    summary = period_summary(entities, roles)
    scores = confidence_score(overall(summary, roles))
    return {"entities": entities, "summary": summary, "scores": scores, "impact": tier_impact(entities, tiers, roles),
            "adjustments": entity_adjustments(entities, scores, settings, roles)}


def verdicts(metrics: DataFrame, model: str = "model") -> DataFrame:
    """(model, metric, verdict) by fixed bands."""
    bias = F.col("bias_pct")
    # Bands of the verdicts.
    rules = {
        "mape": F.when(F.col("mape") < 10, "excellent").when(F.col("mape") < 20, "good").when(F.col("mape") < 30, "fair").otherwise("poor"),
        "r2": S.bands("r2", [(0.9, "strong"), (0.7, "good"), (0.5, "moderate")], "weak", strict=True),
        "bias": F.when(F.abs(bias) < 5, "minimal").when(bias > 5, "overestimates").when(bias < -5, "underestimates").otherwise("borderline"),
        "direction": S.bands("direction", [(80.0, "excellent"), (70.0, "good"), (60.0, "fair")], "poor", strict=True),
        "theil_u": F.when(F.col("theil_u") < 1, "beats naive").when(F.col("theil_u") > 1, "worse than naive").otherwise("equal"),
    }
    return metrics.select(model, *[v.alias(k) for k, v in rules.items()]).unpivot([model], list(rules), "metric", "verdict")


