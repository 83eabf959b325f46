"""Folds, smoothers, forecasters and sources against short loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import scalars as S, series as fs
from panelloom.operators import causal as ca, dynamics as dy, forecast as fc, harmonize as hz, indicators as ind, quality as Q
from panelloom.roles import DEFAULT, HarmonizeSettings
from panelloom.sources import readers as R

ONE = DEFAULT.with_(by=())


def monthly(spark, values, key=1):
    rows = [(key, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key long, date date, value double")


def test_growth_bounds_two_back(spark):
    v = [10.0, 20.0, 100.0, 5.0, 90.0, 30.0]
    df = spark.createDataFrame(list(enumerate(v)), "t int, v double").withColumn("k", F.lit(1))
    got = [x.v for x in fs.growth_bounds(df, ["k"], "t", "v", -30, 50, 2).orderBy("t").collect()]
    want = list(v)
    for i in range(2, len(v)):
        g = (want[i] / want[i - 2] - 1) * 100
        want[i] = want[i - 2] * 1.5 if g > 50 else want[i - 2] * 0.7 if g < -30 else want[i]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("sigma", [0.7, 2.0])
def test_gaussian_mirrors_the_ends(spark, sigma):
    v = np.array([3.0, 8.0, 1.0, 9.0, 4.0])
    df = spark.createDataFrame([(list(map(float, v)),)], "v array<double>")
    got = df.select(hz.gaussian(F.col("v"), F.lit(sigma)).alias("o")).head().o
    r = int(4 * sigma + 0.5)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    padded = np.pad(v, r, mode="symmetric") if r <= 5 else np.array([v[(lambda j: j if j < 5 else 9 - j)((i) % 10)] for i in range(-r, 5 + r)])
    assert got == pytest.approx([(padded[i:i + 2 * r + 1] * k).sum() / k.sum() for i in range(5)])


def test_harmonize_keeps_strict_history_and_shapes(spark):
    rows = [(1, "a", 2000 + i, 100.0 * 1.1 ** i) for i in range(12)] + [(2, "b", 2000 + i, 50.0 + 30 * (-1) ** i) for i in range(12)] + [(3, "c", 2000, 5.0)]
    df = spark.createDataFrame(rows, "id long, name string, year int, value double")
    for method in ("gaussian", "rolling", "monotone", "adaptive"):
        got = hz.harmonize(df, 2007, HarmonizeSettings(method=method), ONE).toPandas()
        assert len(got) == 25 and (got.harmonized >= 0).all()
        kept = got[got.year <= 2005]
        assert np.allclose(kept.harmonized, kept.value)


def test_monotone_curve_keeps_a_line(spark):
    df = spark.createDataFrame([([float(i) for i in range(20)], 20, 0.0)], "v array<double>, h int, s double")
    got = df.select(hz.smooth_monotone(F.col("v"), F.size("v"), F.col("h"), F.col("s")).alias("o")).head().o
    assert got == pytest.approx(list(range(20)), abs=1e-9)


def test_warping_against_full_matrix(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(9), rng.random(9)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, year int, x double, y double")
    got = ind.warping_similarity(df, ["id"], "year", "x", "y").head().similarity
    a, b = ((v - v.min()) / (v.max() - v.min() + 1e-8) for v in (x, y))
    d = np.full((9, 9), np.inf)
    d[0, 0] = abs(a[0] - b[0])
    for i in range(1, 9):
        for j in range(1, 9):
            d[i, j] = abs(a[i] - b[j]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    assert got == pytest.approx(1 - d[8, 8] / 18)


def test_exact_exponential_and_line(spark):
    grow = monthly(spark, [100 * 1.02 ** i for i in range(36)])
    got = [x.value for x in fc.exponential(grow, 3).orderBy("date").collect()]
    assert got == pytest.approx([100 * 1.02 ** i for i in (36, 37, 38)])
    line = monthly(spark, [10 + 3 * i for i in range(24)])
    assert [x.value for x in fc.linear(line, 2).orderBy("date").collect()] == pytest.approx([82, 85])
    assert fc.linear(line, 1).head().date == dt.date(2002, 1, 1)


def test_exact_logistic_is_found(spark):
    a = 100.0 * 1.2
    t = np.arange(12)
    top = a / (1 + np.exp(-0.9 * (11 - 5)))
    v = a / (1 + np.exp(-0.9 * (t - 5)))
    got = fc.fit_curves(monthly(spark, v), "logistic", (a / top,)).head()
    assert (got.b, got.c) == (pytest.approx(5.0, abs=1e-6), pytest.approx(0.9, abs=1e-6)) and got.sse < 1e-9


def test_multiplicative_smoothing(spark):
    v = [10.0, 12.0, 13.0, 17.0, 18.0]
    al, be, ph = 0.3, 0.1, 0.9
    level, trend = v[0], v[1] / v[0]
    for y in v[1:]:
        guess = level * trend ** ph
        new = al * y + (1 - al) * guess
        trend = be * new / level + (1 - be) * trend ** ph
        level = new
    got = fc.exponential_smoothing(monthly(spark, v), 2, kind="double", phi=ph, multiplicative=True).orderBy("horizon").collect()
    assert got[1].value == pytest.approx(level * trend ** (ph + ph ** 2))


def test_constant_series_is_safe(spark):
    flat = monthly(spark, [5.0] * 30)
    assert ca.cusum(flat).where("is_change").count() == 0
    assert ind.rolling(flat.withColumn("x", F.lit(1.0)), ["key"], "date", "x", "value").where("rolling_corr is not null").count() == 0
    assert fc.forecast_many(flat, ["cagr", "moving_average", "exponential_smoothing", "linear", "naive", "seasonal_naive", "quadratic"], 2).where("value <> 5.0").count() == 0
    assert dy.best_curve(dy.curve_fits(flat)).count() == 1


def test_phase_smoothing(spark):
    seq = ["growth", "decline", "growth", "growth", "maturity"]
    df = spark.createDataFrame([(1, 2000 + i, p) for i, p in enumerate(seq)], "id long, year int, market_phase string")
    got = [x.smoothed_phase for x in dy.smooth_phases(df, ONE).orderBy("year").collect()]
    # decline may not turn into growth, maturity may.
    assert got == ["growth", "decline", "growth", "growth", "growth"]


def test_scalars(spark):
    row = spark.range(1).select(S.cagr_percent(F.lit(-2.0), F.lit(3.0), 2).alias("a"), S.cagr_percent(F.lit(0.0), F.lit(3.0), 2).alias("b"), S.cagr_percent(F.lit(1.0), F.lit(4.0), 2).alias("c"),
                                S.growth_rate(F.lit(None).cast("double"), F.lit(1.0)).alias("d"), S.growth_rate(F.lit(5.0), F.lit(0.0)).alias("e"), S.safe_divide(F.lit(1.0), F.lit(0.0), -1.0).alias("f"),
                                S.currency_label(F.lit(2_500_000.0)).alias("g"), S.cagr_fraction(F.lit(1.0), F.lit(0.0), 3).alias("h")).head()
    assert tuple(row) == (200.0, 100.0, pytest.approx(100.0), 0.0, 500.0, -1.0, "$2.5M", -1.0)


def test_names_and_wide_form(spark):
    assert R.standard_names(["geo_id", "Nation", "fiscal_year", "sales"], "panel") == {"fiscal_year": "year", "sales": "value", "Nation": "name", "geo_id": "id"}
    wide = spark.createDataFrame([(1, "a", 1.0, None), (2, "b", 3.0, 4.0)], "id long, name string, `2019` double, `2020` double")
    assert R.is_wide(wide) and not R.is_wide(R.to_long(wide, ONE))
    assert R.wide_to_long(wide, ONE, drop_nulls=True).count() == 3
    again = R.long_to_wide(R.to_long(wide, ONE), [2019, 2020], "sum", ONE)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def test_rules_and_repairs(spark, panel):
    bad = {x.rule: x.n_bad for x in Q.rule_report(panel, Q.panel_rules()).collect()}
    assert bad["value_missing"] == 1 and bad["year_out_of_range"] == 0
    with pytest.raises(Exception, match="bad row"):
        Q.require(panel, Q.panel_rules()).collect()
    nan = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 2.0), (1, 3, float("inf")), (1, 4, 3.0)], "key long, date int, value double")
    assert [x.value for x in Q.repair_series(nan).orderBy("date").collect()] == [2.0, 2.0, 2.0, 3.0]


def test_pooled_learner_follows_a_line(spark):
    both = monthly(spark, [10 + 2 * i for i in range(36)], 1).unionByName(monthly(spark, [200 - i for i in range(36)], 2))
    got = fc.pooled(both, 2, learner="ridge", regularization=0.0).where("key = 1").orderBy("date").toPandas()
    assert np.allclose(got.value, [82, 84], atol=0.5)


def test_bass_recovers_parameters(spark):
    m, p, q = 1000.0, 0.03, 0.4
    total, v = 0.0, []
    for _ in range(15):
        n = (p + q * total / m) * (m - total)
        v.append(n)
        total += n
    got = fc.fit_bass(monthly(spark, v)).head()
    assert (got.m, got.p, got.q) == (pytest.approx(m, rel=1e-3), pytest.approx(p, rel=1e-3), pytest.approx(q, rel=1e-3))


def test_collinear_column_is_dropped(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(200), rng.random(200)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + 1e-3 * rng.random(200)}))
    kept, table = ind.drop_collinear(df, ["a", "b", "c"])
    assert "b" in kept and len(kept) == 2 and table.where("not kept").count() == 1
