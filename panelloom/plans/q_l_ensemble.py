"""Ensembles and model choice."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage, dealt
from panelloom.functions.stats import critical_t
from panelloom.operators import ensemble as en, forecast as fc, regimes as rg, stacking as st
from panelloom.plans.base import NEEDS, SQL, ctes, monthly, query, r, sql_uniform, tidy
from panelloom.plans.q_k_forecast import H, _LX, _STEPS, held, months

SQL["fx"] = _LX
NEEDS["fx"] = ("lines",)
SQL["fcs"] = f"""SELECT key, date, 'linear' AS model, horizon, greatest(a + b * x, 0) AS value FROM fx UNION ALL SELECT key, date, 'exponential', horizon, exp(ll + rate * x) FROM fx
  UNION ALL SELECT l.key, fx.date, 'naive', fx.horizon, l.lv FROM lastd l JOIN fx USING (key)"""
NEEDS["fcs"] = ("fx", "lastd")
MODELS = ["linear", "exponential", "naive"]
SQL["perf"] = """SELECT key, model, avg(abs(p - a) / a) * 100 AS mape, sqrt(avg((p - a) ** 2)) AS rmse, avg(p - a) AS bias, 1 / (1 + var_pop(p - a)) AS cons, coalesce(avg(hit), 0) AS dir FROM (
  SELECT f.key, f.model, f.date, f.value AS p, m.value AS a, CASE WHEN lag(f.value) OVER w IS NOT NULL THEN (sign(m.value - lag(m.value) OVER w) = sign(f.value - lag(f.value) OVER w))::INT END AS hit
  FROM hfcs f JOIN monthly m USING (key, date) WINDOW w AS (PARTITION BY f.key, f.model ORDER BY f.date)) GROUP BY 1, 2"""
NEEDS["perf"] = ("hfcs", "monthly")
SQL["perfc"] = "SELECT *, 0.4 * greatest(0, 1 - mape / 100) + 0.3 / (1 + rmse) + 0.2 * cons + 0.1 * dir AS comp FROM perf"
NEEDS["perfc"] = ("perf",)
OUT = dict(key="bigint", date="date", horizon="int", value=4, lower=4, upper=4)
_SEL = "SELECT key, date, CAST(horizon AS INTEGER) AS horizon, "


SQL["hfx"], SQL["hfcs"] = SQL["fx"].replace("FROM lines", "FROM hlines"), SQL["fcs"].replace("FROM fx", "FROM hfx").replace("fx.", "hfx.").replace("JOIN fx", "JOIN hfx").replace("lastd", "hlastd")
NEEDS["hfx"], NEEDS["hfcs"] = ("hlines",), ("hfx", "hlastd")


def fcs(spark, sf):
    return fc.forecast_many(monthly(spark, sf), MODELS, H)


def held_fcs(series):
    """Forecasts of the last H months of each key from what came before, and these months."""
    history, later = held(series)
    return fc.forecast_many(history, MODELS, H), later


def perf(series):
    return en.performance(*held_fcs(series))


def _band(center):
    return ctes("fcs", s=f"SELECT key, date, horizon, {center} AS v, stddev_pop(value) AS s FROM fcs GROUP BY 1, 2, 3") + _SEL + f"{r('greatest(v, 0)', 4)} AS value, {r('greatest(v - 1.96 * s, 0)', 4)} AS lower, {r('v + 1.96 * s', 4)} AS upper FROM s"


@query("l01_mean_ensemble", _band("avg(value)"))
def _(spark, sf):
    return tidy(en.simple(fcs(spark, sf)), **OUT)


@query("l01_median_ensemble", _band("median(value)"))
def _(spark, sf):
    return tidy(en.simple(fcs(spark, sf), "median"), **OUT)


@query("l01_trimmed_ensemble", ctes("fcs", k="SELECT *, row_number() OVER (PARTITION BY key, date ORDER BY value, model) AS rn FROM fcs", s="SELECT key, date, horizon, avg(value) FILTER (WHERE rn = 2) AS v, stddev_pop(value) AS s FROM k GROUP BY 1, 2, 3") +
       _SEL + f"{r('greatest(v, 0)', 4)} AS value, {r('greatest(v - 1.96 * s, 0)', 4)} AS lower, {r('v + 1.96 * s', 4)} AS upper FROM s")
def _(spark, sf):
    return tidy(en.simple(fcs(spark, sf), "trimmed_mean", 0.34), **OUT)


@query("l02_ensemble_weights", ctes("perf") + f"""SELECT key, model, 'inverse_error' AS method, {r('(1 / (mape + 1e-10)) / sum(1 / (mape + 1e-10)) OVER (PARTITION BY key)')} AS weight FROM perf
  UNION ALL SELECT key, model, 'performance', {r('(1 / (1 + mape)) / sum(1 / (1 + mape)) OVER (PARTITION BY key)')} FROM perf UNION ALL SELECT key, model, 'equal', {r('1.0 / 3')} FROM perf
  UNION ALL SELECT key, model, 'custom', {r("CASE model WHEN 'linear' THEN 0.75 WHEN 'naive' THEN 0.25 ELSE 0 END")} FROM perf""")
def _(spark, sf):
    p = dealt(cut_lineage(perf(months(spark, sf))), "key")
    out = None
    for m in ("inverse_error", "performance", "equal", "custom"):
        d = en.weights(p, m, custom={"linear": 3.0, "naive": 1.0}).select("key", "model", F.lit(m).alias("method"), "weight")
        out = d if out is None else out.unionByName(d)
    return tidy(out, key="bigint", model="string", method="string", weight=6)


SQL["invw"] = "SELECT key, model, (1 / (mape + 1e-10)) / sum(1 / (mape + 1e-10)) OVER (PARTITION BY key) AS weight FROM perf"
NEEDS["invw"] = ("perf",)


@query("l03_weighted_ensemble", ctes("invw", w="SELECT key, date, horizon, sum(weight * value) / sum(weight) AS m, sum(weight * value * value) / sum(weight) AS q FROM hfcs JOIN invw USING (key, model) GROUP BY 1, 2, 3",
                                     s="SELECT *, sqrt(avg(greatest(q - m * m, 0)) OVER (PARTITION BY key)) AS s FROM w") +
       _SEL + f"{r('m', 3)} AS value, {r('greatest(m - 1.959963984540054::DOUBLE * s * sqrt(horizon), 0)', 1)} AS lower, {r('m + 1.959963984540054::DOUBLE * s * sqrt(horizon)', 1)} AS upper FROM s")
def _(spark, sf):
    f, later = held_fcs(months(spark, sf))
    return tidy(en.weighted(f, en.weights(en.performance(f, later))), key="bigint", date="date", horizon="int", value=3, lower=1, upper=1)


@query("l04_stacking")
def _(spark, sf):
    f, later = held_fcs(months(spark, sf))
    return en.stacking(cut_lineage(f), later, MODELS, 3)


_ROLL = ctes("monthly", i="SELECT key, date, value AS v, year(date) * 12 + month(date) - min(year(date) * 12 + month(date)) OVER (PARTITION BY key) AS x FROM monthly",
             o="""SELECT key, date, x, v, count(*) OVER w AS n, regr_slope(v, x) OVER w AS b, regr_intercept(v, x) OVER w AS a, regr_slope(CASE WHEN v > 0 THEN ln(v) END, x) OVER w AS g, regr_intercept(CASE WHEN v > 0 THEN ln(v) END, x) OVER w AS l,
    min(v) OVER w AS low, max(v) OVER w AS high FROM i WINDOW w AS (PARTITION BY key ORDER BY x ROWS UNBOUNDED PRECEDING)""",
             pr=f"""SELECT o.key, o.date AS origin, y.date, h.horizon, greatest(o.a + o.b * (o.x + horizon), 0) AS linear, CASE WHEN o.low > 0 THEN least(exp(least(o.l + o.g * (o.x + horizon), 700)), 10 * o.high) END AS exponential, o.v AS naive, y.v AS actual
    FROM o CROSS JOIN range(1, {H + 1}) h(horizon) JOIN i y ON y.key = o.key AND y.x = o.x + h.horizon WHERE o.n >= 6""")


@query("l04_rolling_errors", _ROLL + f"SELECT key, CAST(horizon AS INTEGER) AS horizon, count(*)::BIGINT AS pairs, " + ", ".join(f"{r(f'sum(abs({m} - actual)) / sum(abs(actual))')} AS {m}" for m in st.MEMBERS) + " FROM pr GROUP BY 1, 2")
def _(spark, sf):
    """Sum of absolute errors of each member as a share of the values, by key and step, over all origins."""
    pairs = st.rolling_pairs(monthly(spark, sf), H)
    out = pairs.groupBy("key", "horizon").agg(F.count(F.lit(1)).alias("pairs"), *[F.try_divide(F.sum(F.abs(F.col(m) - F.col("actual"))), F.sum(F.abs("actual"))).alias(m) for m in st.MEMBERS])
    return tidy(out, key="bigint", horizon="int", pairs="bigint", **{m: 6 for m in st.MEMBERS})


@query("l04_rolling_stacking")
def _(spark, sf):
    return tidy(st.rolling_stacking(monthly(spark, sf), H), key="bigint", date="date", horizon="int", value=4, pairs="bigint", reason="string")


@query("l05_boosting", ctes("series", b="SELECT *, month(date) AS m FROM series",
                            r1="SELECT key, regr_slope(value, t) AS b, avg(value) - regr_slope(value, t) * avg(t) AS a FROM b GROUP BY 1", e1="SELECT x.*, value - 0.5 * (a + b * t) AS r1 FROM b x JOIN r1 USING (key)",
                            r2="SELECT key, m, avg(r1) AS c FROM e1 GROUP BY 1, 2", e2="SELECT x.*, r1 - 0.5 * c AS r2 FROM e1 x JOIN r2 USING (key, m)",
                            r3="SELECT key, regr_slope(r2, t) AS b, avg(r2) - regr_slope(r2, t) * avg(t) AS a FROM e2 GROUP BY 1", e3="SELECT x.*, r2 - 0.5 * (a + b * t) AS r3 FROM e2 x JOIN r3 USING (key)",
                            r4="SELECT key, m, avg(r3) AS c FROM e3 GROUP BY 1, 2",
                            x="SELECT l.key, CAST(l.ld + to_months(CAST(horizon AS INTEGER)) AS DATE) AS date, horizon, n - 1 + horizon AS t FROM lines2 l, ".replace("lines2", "(SELECT key, max(date) AS ld, max(n) AS n FROM series GROUP BY 1)") + _STEPS) +
       _SEL + f"{r('0.5 * (r1.a + r1.b * t) + 0.5 * coalesce(r2.c, 0) + 0.5 * (r3.a + r3.b * t) + 0.5 * coalesce(r4.c, 0)', 4)} AS value FROM x JOIN r1 USING (key) JOIN r3 USING (key) LEFT JOIN r2 ON r2.key = x.key AND r2.m = month(date) LEFT JOIN r4 ON r4.key = x.key AND r4.m = month(date)")
def _(spark, sf):
    return tidy(en.boosting(monthly(spark, sf), H), key="bigint", date="date", horizon="int", value=4)


_BAG = ctes("series", s=f"SELECT key, t, value, rep FROM series, range(1, 21) g(rep) WHERE {sql_uniform('key', 'CAST(t AS DOUBLE)', 'rep')} < 0.8", f="SELECT key, rep, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM s GROUP BY 1, 2",
            l="SELECT key, max(date) AS ld, max(n) AS n FROM series GROUP BY 1", x=f"SELECT key, CAST(ld + to_months(CAST(horizon AS INTEGER)) AS DATE) AS date, horizon, a + b * (n - 1 + horizon) AS v FROM f JOIN l USING (key), {_STEPS}")


@query("l06_bagging", _BAG + _SEL + f"{r('avg(v)', 4)} AS value, {r('quantile_cont(v, 0.025)', 4)} AS lower, {r('quantile_cont(v, 0.975)', 4)} AS upper FROM x GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(en.bagging(monthly(spark, sf), H), **OUT)


@query("l07_backtest", ctes("monthly", o="SELECT key, date, value, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS r FROM monthly", q="SELECT key, arg_max(value, date) AS lv FROM o WHERE r > 4 GROUP BY 1",
                            p="SELECT o.key, o.date, o.value AS a, q.lv AS p FROM o JOIN q USING (key) WHERE r <= 4",
                            h="SELECT *, CASE WHEN lag(a) OVER w IS NOT NULL THEN (sign(a - lag(a) OVER w) = sign(p - lag(p) OVER w))::INT END AS hit FROM p WINDOW w AS (PARTITION BY key ORDER BY date)",
                            e="SELECT key, avg(abs(p - a) / a) * 100 AS mape, sqrt(avg((p - a) ** 2)) AS rmse, 1 / (1 + var_pop(p - a)) AS c, coalesce(avg(hit), 0) AS d FROM h GROUP BY 1") +
       f"SELECT key, 'naive' AS model, {r('mape')} AS mape, {r('rmse', 4)} AS rmse, {r('d')} AS direction, {r('0.4 * greatest(0, 1 - mape / 100) + 0.3 / (1 + rmse) + 0.2 * c + 0.1 * d')} AS composite FROM e")
def _(spark, sf):
    # Every month of a supplier is held, so the held-out rows are matched by date against a flat forecast of each.
    past, test = en.split(monthly(spark, sf), 4)
    last = past.groupBy("key").agg(F.max_by("value", "date").alias("value"))
    flat = test.select("key", "date").join(last, "key").withColumn("model", F.lit("naive"))
    return tidy(en.performance(flat, test), key="bigint", model="string", mape=6, rmse=4, direction=6, composite=6)


SQL["cond"] = """SELECT key, date, vol, tp, slope, strength, mom, CASE WHEN vol > 0.1 AND abs(mom) > 0.05 THEN 'volatile_trending' WHEN vol > 0.1 THEN 'volatile_sideways' WHEN strength > 0.7 AND abs(mom) > 0.02 THEN 'stable_trending' ELSE 'stable_sideways' END AS regime,
  CASE WHEN r5 > 0.1 AND rv < 0.05 THEN 'growth' WHEN r5 > 0.05 AND rv > 0.05 THEN 'expansion' WHEN abs(r5) < 0.02 AND rv < 0.03 THEN 'maturity' WHEN r5 < -0.05 THEN 'decline' ELSE 'transition' END AS phase, pred FROM (
  SELECT key, max(date) AS date, stddev_pop(ret) FILTER (WHERE t > n - 12) AS vol, regr_slope(value, t) FILTER (WHERE t >= n - 12) AS slope, abs(corr(value, t) FILTER (WHERE t >= n - 12)) AS strength,
    (avg(value) FILTER (WHERE t >= n - 5) - avg(value) FILTER (WHERE t >= n - 12)) / avg(value) FILTER (WHERE t >= n - 12) AS mom,
    (arg_max(value, t) - max(value) FILTER (WHERE t = n - 5)) / max(value) FILTER (WHERE t = n - 5) AS r5, stddev_pop(ret) FILTER (WHERE t >= n - 5) AS rv, abs(corr(value, prev) FILTER (WHERE t > n - 12)) AS pred,
    0 AS dummy FROM retn GROUP BY 1) JOIN place USING (key)"""
SQL["retn"] = "SELECT *, lag(value) OVER w AS prev, value / lag(value) OVER w - 1 AS ret FROM series WINDOW w AS (PARTITION BY key ORDER BY date)"
NEEDS["retn"] = ("series",)
SQL["place"] = """SELECT h.key, (count(*) FILTER (WHERE hv < v) + count(*) FILTER (WHERE hv <= v))::DOUBLE / (2 * count(*)) AS tp FROM (SELECT key, t, n, stddev_pop(ret) OVER (PARTITION BY key ORDER BY date ROWS 10 PRECEDING) AS hv FROM retn) h
  JOIN (SELECT key, stddev_pop(ret) FILTER (WHERE t > n - 12) AS v FROM retn GROUP BY 1) c USING (key) WHERE h.t >= 11 AND h.t < h.n - 1 GROUP BY 1"""
NEEDS["place"] = ("retn",)
NEEDS["cond"] = ("retn", "place")


@query("l08_optimized_weights", ctes("perfc", "cond", a="SELECT p.key, p.model, comp, greatest(CASE WHEN regime LIKE 'volatile%' THEN 0.6 * cons + 0.4 * dir ELSE 0.7 * (1 - mape / 100) + 0.3 * (1 - abs(bias) / 10) END, 0) AS raw, pred FROM perfc p JOIN cond USING (key)",
                                     c="SELECT *, max(raw) OVER w > 0.5 AS hot, sum(greatest(raw - 0.4, 0)) OVER w AS x, count(*) FILTER (WHERE raw < 0.4) OVER w AS k FROM a WINDOW w AS (PARTITION BY key)",
                                     d="SELECT *, CASE WHEN pred < 0.3 AND hot THEN CASE WHEN raw >= 0.4 THEN 0.4 ELSE raw + x / k END ELSE raw END AS z FROM c", n="SELECT *, comp / sum(comp) OVER (PARTITION BY key) AS pw FROM a") + f"""
  SELECT key, model, 'adaptive' AS method, {r('CASE WHEN sum(z) OVER (PARTITION BY key) > 0 THEN z / sum(z) OVER (PARTITION BY key) ELSE 1.0 / 3 END')} AS weight FROM d
  UNION ALL SELECT key, model, 'performance', {r('pw')} FROM n UNION ALL SELECT key, model, 'diversified', {r('0.7 * pw + 0.1')} FROM n""")
def _(spark, sf):
    p, c = cut_lineage(perf(months(spark, sf))), cut_lineage(rg.market_conditions(monthly(spark, sf)))
    out = None
    for m in ("adaptive", "performance", "diversified"):
        d = en.optimize(p, c, m).select("key", "model", F.lit(m).alias("method"), "weight")
        out = d if out is None else out.unionByName(d)
    return tidy(out, key="bigint", model="string", method="string", weight=6)


_CRIT = critical_t(0.05, 3)


@query("l09_performance_trend", ctes("series", t="SELECT key, value / 10000 AS v, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS r FROM series", f="SELECT key, count(v) AS n, avg(v) AS m, regr_slope(v, -r) AS s, corr(v, -r) AS c FROM t WHERE r <= 5 GROUP BY 1") +
       f"SELECT key, n::BIGINT AS n, {r('m')} AS recent_mean, {r('s')} AS slope, CASE WHEN abs(c * sqrt(3 / (1 - c * c))) <= {_CRIT} THEN 'no_trend' WHEN s < -1 THEN 'improving' WHEN s > 1 THEN 'deteriorating' ELSE 'stable' END AS trend FROM f")
def _(spark, sf):
    d = monthly(spark, sf).withColumn("v", F.col("value") / 10000)
    return tidy(rg.error_trend(d, ["key"], "date", "v", limit=1.0), key="bigint", n="bigint", recent_mean=6, slope=6, trend="string")


@query("l10_hybrid", ctes("series", f="SELECT key, date, t, n, value AS l, NULL::DOUBLE AS e FROM series WHERE t = 0 UNION ALL SELECT b.key, b.date, b.t, b.n, 0.3 * b.value + 0.7 * a.l, b.value - a.l FROM f a JOIN series b ON b.key = a.key AND b.t = a.t + 1",
                          p="SELECT *, lag(e) OVER (PARTITION BY key ORDER BY t) AS p FROM f", q="SELECT key, max(date) AS ld, arg_max(l, t) AS l, arg_max(e, t) AS e, regr_slope(e, p) AS phi, regr_intercept(e, p) AS c FROM p GROUP BY 1",
                          h=f"SELECT key, ld, l, phi, c, 1 AS horizon, c + phi * e AS e FROM q UNION ALL SELECT key, ld, l, phi, c, horizon + 1, c + phi * e FROM h WHERE horizon < {H}") +
       f"SELECT key, CAST(ld + to_months(horizon) AS DATE) AS date, horizon::INTEGER AS horizon, {r('greatest(l + e, 0)', 4)} AS value FROM h")
def _(spark, sf):
    return tidy(en.hybrid(monthly(spark, sf), H), key="bigint", date="date", horizon="int", value=4)


@query("l11_adapted_weights", ctes("invw", "perfc", "cond", a="SELECT p.key, p.model, greatest(CASE WHEN regime LIKE 'volatile%' THEN 0.6 * cons + 0.4 * dir ELSE 0.7 * (1 - mape / 100) + 0.3 * (1 - abs(bias) / 10) END, 0) AS raw, pred FROM perfc p JOIN cond USING (key)",
                                   c="SELECT *, max(raw) OVER w > 0.5 AS hot, sum(greatest(raw - 0.4, 0)) OVER w AS x, count(*) FILTER (WHERE raw < 0.4) OVER w AS k FROM a WINDOW w AS (PARTITION BY key)",
                                   d="SELECT *, CASE WHEN pred < 0.3 AND hot THEN CASE WHEN raw >= 0.4 THEN 0.4 ELSE raw + x / k END ELSE raw END AS z FROM c") + f"""
  SELECT key, model, 1 AS version, {r('weight')} AS weight FROM invw UNION ALL SELECT key, model, 2, {r('CASE WHEN sum(z) OVER (PARTITION BY key) > 0 THEN z / sum(z) OVER (PARTITION BY key) ELSE 1.0 / 3 END')} FROM d""")
def _(spark, sf):
    p = cut_lineage(perf(months(spark, sf)))
    return tidy(en.adapt(monthly(spark, sf), p, en.weights(p), 2), key="bigint", model="string", version="int", weight=6)
