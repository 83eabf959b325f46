"""Market dynamics: phases, growth bands, growth curves per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds, scalars as S
from panelloom.operators import forecast as fc, shares as sh
from panelloom.operators.harmonize import gradient_inflections
from panelloom.roles import DEFAULT, Roles

# Growth band in % and typical length in years of each phase.
PHASES = {"introduction": (-20.0, 100.0, 1, 3), "growth": (15.0, 60.0, 3, 7), "maturity": (-5.0, 20.0, 5, 15),
          "decline": (-50.0, 5.0, 3, 10), "disruption": (-70.0, 150.0, 1, 3)}
# Phases each phase may turn into.
FOLLOWERS = {"introduction": ("growth", "decline"), "growth": ("maturity", "disruption"), "maturity": ("decline", "disruption", "growth"),
             "decline": ("disruption", "introduction"), "disruption": ("introduction", "growth", "maturity", "decline")}


def _w(roles: Roles):
    return W.partitionBy(*roles.entity).orderBy(roles.year)


def features(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Adds growth (0 for the first year), market share, and growth volatility over three rows (at least two, else 0)."""
    out = sh.market_shares(df, roles, "zero")
    w = _w(roles)
    n = F.count(F.lit(1)).over(W.partitionBy(*roles.entity))
    out = out.withColumn("_g", (F.try_divide(F.col(roles.value), F.lag(roles.value).over(w)) - 1) * 100).withColumn("_n", n)
    vol = F.when(F.col("_n") > 2, F.coalesce(F.stddev_samp("_g").over(w.rowsBetween(-2, 0)), F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumn("volatility", vol).withColumn("growth_rate", F.coalesce("_g", F.lit(0.0))).drop("_g")


def phase(growth: Column, volatility: Column, share: Column) -> Column:
    return (F.when((growth > 30) & (share < 5), "introduction").when(growth > 15, "growth")
            .when((growth > -5) & (volatility > 15), "disruption").when(growth > -5, "maturity").when(volatility > 20, "disruption").otherwise("decline"))


def phases(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Adds ``market_phase`` per entity-year from its rolling features; fewer than three years is too little."""
    f = features(df, roles)
    return f.withColumn("market_phase", F.when(F.col("_n") < 3, "insufficient_data").otherwise(phase(F.col("growth_rate"), F.col("volatility"), F.col("market_share")))).drop("_n")


def smooth_phases(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Adds ``smoothed_phase``: majority of the smoothed phase before, the own and the next one; earlier ones win ties. A change
    needs an allowed transition."""
    rows = df.withColumn("_next", F.lead("market_phase").over(_w(roles)))

    def step(s: Column, x: Column) -> dict[str, Column]:
        own = x["market_phase"]
        common = F.when(s["p"].isNull() | (own == x["_next"]), own).otherwise(s["p"])
        allowed = reduce(lambda a, b: a | b, [(own == k) & common.isin(*v) for k, v in FOLLOWERS.items()]) | own.isin("insufficient_data", "unknown")
        return {"p": F.when((common != own) & allowed, common).otherwise(own)}

    out = folds.scan_rows(rows, roles.entity, roles.year, {"p": F.lit(None).cast("string")}, step, lambda s, x: {"smoothed_phase": s["p"]}, "smoothed_phase string")
    return out.select(*df.columns, "smoothed_phase")


def _band(name: Column, index: int, default: float | None) -> Column:
    out = None
    for k, v in PHASES.items():
        out = F.when(name == k, v[index]) if out is None else out.when(name == k, v[index])
    return out.otherwise(default)


def clamp_growth(df: DataFrame, last_historical: int, phase_col: str = "market_phase", roles: Roles = DEFAULT) -> DataFrame:
    """Forecast growth held to the band of the entity's latest phase, values compounded from the last kept value."""
    last = F.last(phase_col).over(_w(roles).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    v = roles.value
    rows = (df.withColumn("_low", _band(last, 0, None).cast("double")).withColumn("_high", _band(last, 1, None).cast("double"))
            .withColumn("_g", (F.try_divide(F.col(v), F.lag(v).over(_w(roles))) - 1) * 100))

    def step(s: Column, x: Column) -> dict[str, Column]:
        held = S.clip(x["_g"], x["_low"], x["_high"])
        move = (x[roles.year] > last_historical) & s["v"].isNotNull() & x["_g"].isNotNull() & x["_low"].isNotNull()
        return {"v": F.when(move, s["v"] * (1 + held / 100)).otherwise(x[v]), "g": F.when(move, held).otherwise(x["_g"])}

    none = F.lit(None).cast("double")
    out = folds.scan_rows(rows, roles.entity, roles.year, {"v": none, "g": none}, step, lambda s, x: {"_new": s["v"], "growth_held": s["g"]}, "_new double, growth_held double")
    keep = [c for c in df.columns if c not in (v, "growth_held")]
    return out.select(*keep, F.col("_new").alias(v), "growth_held")


def curve_fits(series: DataFrame) -> DataFrame:
    """(key, model, a, b, c, rmse, n): linear, exponential, logistic, Gompertz and Bass fits of each series in one table."""
    rows = fc.indexed(series)
    n = rows.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    v, t = F.col("value"), F.col("t")
    lines = rows.groupBy("key").agg(F.regr_intercept(v, t).alias("la"), F.regr_slope(v, t).alias("lb"), F.regr_intercept(F.log(F.when(v > 0, v)), t).alias("ea"), F.regr_slope(F.log(F.when(v > 0, v)), t).alias("eb"))
    scored = rows.join(lines, "key")
    wide = scored.groupBy("key").agg(F.max("la").alias("la"), F.max("lb").alias("lb"), F.exp(F.max("ea")).alias("ea"), F.max("eb").alias("eb"),
                                     F.sum(F.pow(v - (F.col("la") + F.col("lb") * t), F.lit(2.0))).alias("ls"), F.sum(F.pow(v - F.exp(F.col("ea") + F.col("eb") * t), F.lit(2.0))).alias("es"))
    none = F.lit(None).cast("double")
    two = wide.select("key", F.inline(F.array(F.struct(F.lit("linear").alias("model"), F.col("la").alias("a"), F.col("lb").alias("b"), none.alias("c"), F.col("ls").alias("sse")),
                                              F.struct(F.lit("exponential").alias("model"), F.col("ea").alias("a"), F.col("eb").alias("b"), none.alias("c"), F.col("es").alias("sse")))))
    curves = [fc.fit_curves(series, k).select("key", F.lit(k).alias("model"), "a", "b", "c", "sse") for k in ("logistic", "gompertz")]
    bass = (rows.join(fc.fit_bass(series).where("reason IS NULL"), "key").withColumn("_e", fc.bass(t + 1, F.col("m"), F.col("p"), F.col("q")) - fc.bass(t, F.col("m"), F.col("p"), F.col("q")))
            .groupBy("key").agg(F.max("m").alias("a"), F.max("p").alias("b"), F.max("q").alias("c"), F.sum(F.pow(v - F.col("_e"), F.lit(2.0))).alias("sse")).withColumn("model", F.lit("bass")))
    both = reduce(lambda x, y: x.unionByName(y), [two, *curves, bass.select("key", "model", "a", "b", "c", "sse")])
    return both.where(F.col("sse").isNotNull() & ~F.isnan("sse")).join(n, "key").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))


def best_curve(fits: DataFrame) -> DataFrame:
    return fits.groupBy("key").agg(F.min_by(F.struct("model", "a", "b", "c", "rmse"), F.struct("rmse", "model")).alias("_b")).select("key", "_b.*")


def curve_value(model: Column, t: Column, a: Column, b: Column, c: Column) -> Column:
    return (F.when(model == "linear", a + b * t).when(model == "exponential", a * F.exp(b * t)).when(model == "logistic", fc.logistic(t, a, b, c))
            .when(model == "gompertz", fc.gompertz(t, a, b, c)).when(model == "bass", fc.bass(t + 1, a, b, c) - fc.bass(t, a, b, c)))


def project(series: DataFrame, best: DataFrame, horizon: int, frequency: str = "Y") -> DataFrame:
    """(key, date, model, value): fitted values of the best curve on known dates and ahead; a key without one grows by the mean of
    its last three growths."""
    rows = fc.indexed(series)
    w = W.partitionBy("key").orderBy(F.desc("date"))
    recent = rows.withColumn("_g", F.try_divide(F.col("value"), F.lag("value").over(W.partitionBy("key").orderBy("date"))) - 1).withColumn("_r", F.row_number().over(w))
    state = recent.groupBy("key").agg(F.max("date").alias("last_date"), F.max_by("value", "date").alias("_last"), F.avg(F.when(F.col("_r") <= 3, F.col("_g"))).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_n"))
    past = rows.select("key", "date", "t", F.lit(0).alias("horizon"))
    future = fc.ahead(state, horizon, frequency).select("key", "date", (F.col("_n") - 1 + F.col("horizon")).alias("t"), "horizon")
    joined = past.unionByName(future).join(best, "key", "left").join(state.select("key", "_last", "_mean"), "key")
    grown = F.when(F.col("horizon") > 0, F.col("_last") * F.pow(1 + F.coalesce("_mean", F.lit(0.0)), F.col("horizon")))
    value = F.coalesce(curve_value(F.col("model"), F.col("t"), F.col("a"), F.col("b"), F.col("c")), grown)
    return joined.select("key", "date", "horizon", F.coalesce("model", F.lit("recent_growth")).alias("model"), value.alias("value"))


def next_phase(df: DataFrame, growth: Column, phase_col: str = "market_phase", roles: Roles = DEFAULT) -> DataFrame:
    """(entity, current, years_in_phase, next): by how long the phase has been held and the projected growth."""
    last = df.groupBy(*roles.entity).agg(F.max_by(phase_col, roles.year).alias("current"), F.max_by(growth, F.col(roles.year)).alias("_g"))
    held = df.join(last, roles.entity).where(F.col(phase_col) == F.col("current")).groupBy(*roles.entity).agg(F.count(F.lit(1)).alias("years_in_phase"))
    c, g, n = F.col("current"), F.col("_g"), F.col("years_in_phase")
    low, high = _band(c, 2, 0), _band(c, 3, 999)
    late = F.when(c == "introduction", "growth").when(c == "growth", "maturity").when(c == "maturity", "decline").otherwise(c)
    mid = F.when((c == "introduction") & (g > 30), "growth").when((c == "growth") & (g < 15), "maturity").when((c == "maturity") & (g < 0), "decline").otherwise(c)
    return last.join(held, roles.entity).select(*roles.entity, "current", "years_in_phase", F.when(n >= high, late).when(n >= low, mid).otherwise(c).alias("next"))


def analyze(df: DataFrame, roles: Roles = DEFAULT) -> dict[str, DataFrame]:
    """Phases with smoothing, inflection points and the next phase."""
    rows = smooth_phases(phases(df, roles), roles)
    return {"rows": rows, "inflections": gradient_inflections(df, roles), "next": next_phase(rows, F.col("growth_rate"), "smoothed_phase", roles)}
