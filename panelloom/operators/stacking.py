"""Stacking over rolling origins: every row of a series is an origin, and no origin is fitted again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import gram
from panelloom.operators.forecast import MONTHS

MEMBERS = ("linear", "exponential", "naive")
#: Rows an origin needs, pairs a key needs for weights of its own, and the largest multiple of the values seen that an exponential forecast may take.
LEAST_ROWS, LEAST_PAIRS, MOST_GROWTH = 6, 8, 10.0
#: Pull of the weights towards equal ones, as a share of the members' mean variance.
PULL = 0.01


def _origins(series: DataFrame, horizon: int, frequency: str) -> DataFrame:
    """(key, origin, date, horizon, n, last, linear, exponential, naive, actual) for every row as origin and every step; ``actual`` is null where the series has no such period.

    The fits are aggregates over the rows up to the origin, kept up row by row by one window, and the later values are looked up by windows of the same sort: all origins, models
    and steps share a single shuffle by key.
    """
    months = MONTHS[frequency]
    v = F.col("value").cast("double")
    rows = series.select("key", "date", v.alias("v")).where(F.col("date").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    w = W.partitionBy("key").orderBy("x")
    rows = rows.withColumn("x", F.floor((F.year("date") * 12 + F.month("date")) / months).cast("long"))
    rows = rows.withColumn("x", F.col("x") - F.min("x").over(W.partitionBy("key")))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    log = F.when(F.col("v") > 0, F.log("v"))
    rows = rows.select("key", "date", "x", "v", F.count(F.lit(1)).over(so_far).alias("n"), (F.col("x") == F.max("x").over(W.partitionBy("key"))).alias("last"),
                       F.regr_slope("v", "x").over(so_far).alias("_b"), F.regr_intercept("v", "x").over(so_far).alias("_a"),
                       F.regr_slope(log, F.col("x")).over(so_far).alias("_g"), F.regr_intercept(log, F.col("x")).over(so_far).alias("_l"),
                       F.min("v").over(so_far).alias("_low"), F.max("v").over(so_far).alias("_high"),
                       *[F.max("v").over(w.rangeBetween(h, h)).alias(f"_y{h}") for h in range(1, horizon + 1)])

    def step(h: int) -> Column:
        at = F.col("x") + h
        grown = F.least(F.exp(F.least(F.col("_l") + F.col("_g") * at, F.lit(700.0))), MOST_GROWTH * F.col("_high"))
        return F.struct(F.lit(h).alias("horizon"), F.when(F.col("_b").isNotNull(), F.greatest(F.col("_a") + F.col("_b") * at, F.lit(0.0))).alias("linear"),
                        F.when((F.col("_low") > 0) & F.col("_g").isNotNull(), grown).alias("exponential"), F.col("v").alias("naive"), F.col(f"_y{h}").alias("actual"))

    out = rows.select("key", F.col("date").alias("origin"), "n", "last", F.inline(F.array(*[step(h) for h in range(1, horizon + 1)])))
    return out.withColumn("date", F.add_months("origin", F.col("horizon") * months))


def _filled() -> list[Column]:
    """The members, each missing one as the mean of those there are (the last value always is)."""
    there = [F.coalesce(F.col(m), F.lit(0.0)) for m in MEMBERS]
    mean = sum(there[1:], there[0]) / sum([F.col(m).isNotNull().cast("int") for m in MEMBERS[1:]], F.col(MEMBERS[0]).isNotNull().cast("int"))
    return [F.coalesce(F.col(m), mean) for m in MEMBERS]


def rolling_pairs(series: DataFrame, horizon: int, frequency: str = "M", least_rows: int = LEAST_ROWS) -> DataFrame:
    """(key, origin, date, horizon, linear, exponential, naive, actual): forecasts from every origin with at least ``least_rows`` rows, beside what came.

    A series has one row a period; null and NaN values are left out, and a missing period gives no pair. ``exponential`` is null while a value up to the origin is not positive,
    and it and ``linear`` are null at a first row.
    """
    return _origins(series, horizon, frequency).where((F.col("n") >= least_rows) & F.col("actual").isNotNull()).select("key", "origin", "date", "horizon", *MEMBERS, "actual")


def weights(pairs: DataFrame, least_pairs: int = LEAST_PAIRS, pull: float = PULL) -> DataFrame:
    """(key, pairs, intercept, w array in the order of ``MEMBERS``): least squares of what came on the members' forecasts, drawn towards equal weights.

    Each key's pairs become one packed array of sums, merged inside tasks before the shuffle. Keys with fewer pairs have equal weights and no intercept.
    """
    k = len(MEMBERS)
    sums = pairs.groupBy("key").agg(gram.products([F.lit(1.0), *_filled(), F.col("actual")]).alias("_g"))

    def solve(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
        n, mean, c = gram.centred(gram.matrices(batch.column("_g"), k + 2))
        x, y = c[:, :k, :k], c[:, :k, k]
        ridge = np.maximum(pull * np.einsum("gii->g", x) / k, 1e-9)
        w = 1 / k + gram.least_squares(x, y - x.sum(axis=2) / k, ridge)
        w = np.where((n >= least_pairs)[:, None], w, 1 / k)
        start = np.where(n >= least_pairs, mean[:, k] - np.einsum("gi,gi->g", w, mean[:, :k]), 0.0)
        return {"pairs": n.astype(np.int64), "intercept": start, "w": pa.array(list(w), pa.list_(pa.float64()))}

    return gram.solved(sums, solve, ["key"], "pairs long, intercept double, w array<double>")


def rolling_stacking(series: DataFrame, horizon: int, frequency: str = "M", least_rows: int = LEAST_ROWS, least_pairs: int = LEAST_PAIRS, pull: float = PULL) -> DataFrame:
    """(key, date, horizon, value, pairs, reason) for every step after the last row of every key; not below 0.

    The members' weights come from all rolling origins of the key. A key with too few pairs takes the mean of its members and says so in ``reason``.
    """
    own = weights(rolling_pairs(series, horizon, frequency, least_rows), least_pairs, pull)
    ahead = _origins(series, horizon, frequency).where("last").join(own, "key", "left")
    members = F.array(*_filled())
    n = F.coalesce("pairs", F.lit(0).cast("long"))
    each = F.coalesce("w", F.array(*[F.lit(1 / len(MEMBERS))] * len(MEMBERS)))
    value = F.coalesce("intercept", F.lit(0.0)) + F.aggregate(F.zip_with(members, each, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return ahead.select("key", "date", "horizon", F.greatest(value, F.lit(0.0)).alias("value"), n.alias("pairs"), F.when(n < least_pairs, F.lit("too few pairs")).alias("reason"))
