"""Forecasters."""

from pyspark.sql import DataFrame, Window as W, functions as F

from panelloom.functions.session import cut_lineage, dealt
from panelloom.operators import forecast as fc, keyed_fits as kf, shares as sh
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import NEEDS, SQL, ctes, facts, history, mapping, monthly, query, r, tidy, trade

H = 6
OUT = dict(key="bigint", date="date", horizon="int", value=4, lower=4, upper=4)


def months(spark, sf) -> DataFrame:
    """The monthly series, written once and dealt by key: what is fitted, held out and joined afterwards neither sums line items again nor deals anew."""
    return dealt(cut_lineage(monthly(spark, sf)), "key")


def held(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, later): the series without the last H months of each key, and these months, which forecasts are scored on.

    No forecast from the history has a row of the series at its date unless that row is a later one.
    """
    whole = W.partitionBy("key").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = series.where("key IS NOT NULL").withColumn("origin", F.add_months(F.max("date").over(whole), -H))
    return rows.where("date <= origin").drop("origin"), rows.where("date > origin").drop("origin")


SQL["series"] = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY key) AS n FROM monthly"
NEEDS["series"] = ("monthly",)
SQL["held"] = f"""SELECT key, date, value, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY key) AS n
  FROM monthly JOIN (SELECT key, CAST(max(date) - INTERVAL {H} MONTH AS DATE) AS origin FROM monthly GROUP BY 1) USING (key) WHERE date <= origin"""
NEEDS["held"] = ("monthly",)
SQL["lastd"] = "SELECT key, max(date) AS ld, arg_max(value, date) AS lv, arg_min(value, date) AS fv, min(date) AS fd FROM series GROUP BY 1"
NEEDS["lastd"] = ("series",)
_DATE = "CAST(ld + to_months(CAST(horizon AS INTEGER)) AS DATE)"
_STEPS = f"range(1, {H + 1}) g(horizon)"


def _out(value: str, margin: str, src: str, floor: bool = True) -> str:
    g = (lambda x: f"greatest({x}, 0)") if floor else (lambda x: x)
    return f"SELECT key, date, CAST(horizon AS INTEGER) AS horizon, {r(g(value), 4)} AS value, {r(g(f'({value}) - ({margin})'), 4)} AS lower, {r(f'({value}) + ({margin})', 4)} AS upper FROM {src}"


_CAGR = "CASE WHEN fv > 0 THEN least(greatest((pow(lv / fv, 1.0 / ((ld - fd) / 365.25)) - 1) * 100, -50), 200) END"


@query("k01_cagr", ctes("lastd", f=f"SELECT *, {_CAGR} AS c FROM lastd", x=f"SELECT key, horizon, {_DATE} AS date, lv * pow(1 + c / 100, horizon / 12.0) AS v FROM f, {_STEPS}") + _out("v", "abs(v) * 0.1", "x"))
def _(spark, sf):
    return tidy(fc.cagr(monthly(spark, sf), H), **OUT)


@query("k01_cagr_last_years", ctes("series", e="SELECT key, max(date) AS ld FROM series GROUP BY 1", w="SELECT t.*, ld FROM series t JOIN e USING (key) WHERE date >= ld - INTERVAL 24 MONTH",
                                   l="SELECT key, max(ld) AS ld, arg_max(value, date) AS lv, arg_min(value, date) AS fv, min(date) AS fd FROM w GROUP BY 1",
                                   f=f"SELECT *, {_CAGR} AS c FROM l", x=f"SELECT key, horizon, CAST(ld + to_months(CAST(horizon * 3 AS INTEGER)) AS DATE) AS date, lv * pow(1 + c / 100, horizon * 0.25) AS v FROM f, {_STEPS}") + _out("v", "abs(v) * 0.1", "x"))
def _(spark, sf):
    return tidy(fc.cagr(monthly(spark, sf), H, "Q", last_years=2), **OUT)


_TAIL = "SELECT key, date, value, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS r FROM series"


def _ma(weighted: bool) -> str:
    w = "(1 + i)" if weighted else "1"
    tot = "21.0" if weighted else "6.0"
    terms = " + ".join(f"{(k if weighted else 1)} * w[{k}]" for k in range(1, 7))
    return ctes("series", t=_TAIL, l="SELECT key, max(date) AS ld, stddev_pop(value) AS s, list(value ORDER BY date) AS w FROM t WHERE r <= 6 GROUP BY 1",
                p=f"SELECT key, ld, s, 1 AS horizon, w, ({terms}) / {tot} AS v FROM l UNION ALL SELECT key, ld, s, horizon + 1, list_append(w[2:6], v), ({' + '.join(f'{(k if weighted else 1)} * (list_append(w[2:6], v))[{k}]' for k in range(1, 7))}) / {tot} FROM p WHERE horizon < {H}",
                x=f"SELECT key, {_DATE} AS date, horizon, v, s FROM p") + _out("v", "1.96 * s", "x")


@query("k02_moving_average", _ma(False))
def _(spark, sf):
    return tidy(fc.moving_average(monthly(spark, sf), H, window=6), **OUT)


@query("k02_weighted_average", _ma(True))
def _(spark, sf):
    return tidy(fc.moving_average(monthly(spark, sf), H, window=6, weighted=True), **OUT)


@query("k03_simple_smoothing", ctes("series", f="SELECT key, date, t, value AS l, 0.0::DOUBLE AS sse, n FROM series WHERE t = 0 UNION ALL SELECT b.key, b.date, b.t, 0.3 * b.value + 0.7 * a.l, a.sse + (b.value - a.l) ** 2, b.n FROM f a JOIN series b ON b.key = a.key AND b.t = a.t + 1",
                                    e="SELECT key, date AS ld, l, sse, n FROM f WHERE t = n - 1", x=f"SELECT key, {_DATE} AS date, horizon, l, sqrt(sse / (n - 1)) * sqrt(horizon) AS s FROM e, {_STEPS}") + _out("l", "1.96 * s", "x"))
def _(spark, sf):
    return tidy(fc.exponential_smoothing(monthly(spark, sf), H, kind="simple"), **OUT)


@query("k03_double_smoothing", ctes("series", s="SELECT a.key, a.value AS v0, b.value AS v1 FROM series a JOIN series b ON a.key = b.key AND a.t = 0 AND b.t = 1",
                                    f="""SELECT key, 0::BIGINT AS t, v0 AS l, v1 - v0 AS b, 0.0::DOUBLE AS sse FROM s UNION ALL
   SELECT c.key, c.t, 0.3 * c.value + 0.7 * (a.l + 0.9 * a.b), 0.1 * (0.3 * c.value + 0.7 * (a.l + 0.9 * a.b) - a.l) + 0.9 * 0.9 * a.b, a.sse + (c.value - a.l - 0.9 * a.b) ** 2 FROM f a JOIN series c ON c.key = a.key AND c.t = a.t + 1""",
                                    e="SELECT f.key, l.ld, f.l, f.b, f.sse, m.n FROM f JOIN lastd2 l USING (key) JOIN (SELECT DISTINCT key, n FROM series) m ON m.key = f.key AND f.t = m.n - 1".replace("lastd2", "(SELECT key, max(date) AS ld FROM series GROUP BY 1)"),
                                    x=f"SELECT key, {_DATE} AS date, horizon, l + 0.9 * (1 - pow(0.9, horizon)) / 0.1 * b AS v, sqrt(sse / (n - 1)) * sqrt(horizon) AS s FROM e, {_STEPS}") + _out("v", "1.96 * s", "x"))
def _(spark, sf):
    return tidy(fc.exponential_smoothing(monthly(spark, sf), H, kind="double", phi=0.9), **OUT)


SQL["lines"] = """SELECT key, max(date) AS ld, max(n) AS n, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, regr_slope(ln(value), t) AS rate, regr_intercept(ln(value), t) AS ll,
  sqrt(greatest(var_pop(value) * (1 - coalesce(regr_r2(value, t), 0)), 0)) AS s, avg(value) AS ym, avg(t) AS tm, avg(t * t) AS t2m, var_pop(t) AS v1, var_pop(t * t) AS v2, covar_pop(t, t * t) AS c12, covar_pop(value, t) AS c1, covar_pop(value, t * t) AS c2 FROM series GROUP BY 1"""
NEEDS["lines"] = ("series",)
SQL["hlines"], SQL["hlastd"] = SQL["lines"].replace("FROM series", "FROM held"), SQL["lastd"].replace("FROM series", "FROM held")
NEEDS["hlines"] = NEEDS["hlastd"] = ("held",)
_Z = "1.959963984540054::DOUBLE * s * sqrt(horizon)"
_LX = f"SELECT *, {_DATE} AS date, (n - 1 + horizon)::DOUBLE AS x FROM lines, {_STEPS}"


def _completed(sql: str) -> str:
    """The forecasts of a query with the trend line, then the mean, where a key or step has none."""
    return (ctes("lines", x=_LX, f=_out("a + b * x", _Z, "x"), m="SELECT key, avg(value) AS mean FROM series GROUP BY 1") +
            f"SELECT f.key, f.date, f.horizon, " + ", ".join(f"coalesce(q.{c}, f.{c}, {r('mean', 4)}) AS {c}" for c in ("value", "lower", "upper")) +
            f", CASE WHEN q.value IS NULL THEN 'no value of the model' END AS reason FROM f JOIN m USING (key) LEFT JOIN ({sql}) q ON q.key = f.key AND q.horizon = f.horizon")


def _whole(out, model, spark, sf):
    return tidy(fc.complete(out, model, monthly(spark, sf), H), **OUT, reason="string")


@query("k03_triple_smoothing", _completed(ctes("series", i="SELECT key, avg(value) FILTER (WHERE t < 12) AS l, (avg(value) FILTER (WHERE t BETWEEN 12 AND 23) - avg(value) FILTER (WHERE t < 12)) / 12 AS b, list(value ORDER BY t) FILTER (WHERE t < 12) AS first, max(date) AS ld, max(n) AS n FROM series GROUP BY 1 HAVING max(n) >= 24",
                                    f="""SELECT key, 11::BIGINT AS t, l, b, list_transform(first, lambda z: z - l) AS s, 0.0::DOUBLE AS sse, ld, n FROM i UNION ALL
   SELECT key, t, nl, 0.1 * (nl - l) + 0.9 * b, list_append(s[2:12], 0.1 * (value - nl) + 0.9 * s[1]), sse + (value - l - b - s[1]) ** 2, ld, n FROM (
     SELECT c.key, c.t, c.value, a.l, a.b, a.s, a.sse, a.ld, a.n, 0.3 * (c.value - a.s[1]) + 0.7 * (a.l + a.b) AS nl FROM f a JOIN series c ON c.key = a.key AND c.t = a.t + 1)""",
                                    x=f"SELECT key, {_DATE} AS date, horizon, l + horizon * b + s[horizon] AS v, sqrt(sse / (n - 1)) * sqrt(horizon) AS sd FROM f, {_STEPS} WHERE t = n - 1") + _out("v", "1.96 * sd", "x")))
def _(spark, sf):
    return _whole(fc.exponential_smoothing(monthly(spark, sf), H, kind="triple"), "exponential_smoothing", spark, sf)




@query("k04_trend_regression", ctes("lines", x=_LX) + _out("a + b * x", _Z, "x"))
def _(spark, sf):
    return tidy(fc.linear(monthly(spark, sf), H), **OUT)


def _keyed(kind, **how):
    def run(spark, sf):
        out = kf.keyed_regression(monthly(spark, sf), H, kind=kind, **how)
        return tidy(out.withColumn("first_coefficient", F.round(F.get("coefficients", 1), 4)), **OUT, first_coefficient="double")
    return run


query("k04_keyed_polynomial")(_keyed("polynomial", degree=2))
query("k04_keyed_ridge")(_keyed("ridge", alpha=1.0))
query("k04_keyed_lasso")(_keyed("lasso", alpha=100.0))
query("k04_keyed_elasticnet_lags")(_keyed("elasticnet", alpha=100.0, lags=(1, 2, 3)))


@query("k04_pooled_ridge")
def _(spark, sf):
    return fc.complete(fc.pooled(monthly(spark, sf), 3, learner="ridge"), "pooled", monthly(spark, sf), 3)


SQL["ar"] = """SELECT key, date, value, d, lag(d) OVER (PARTITION BY key ORDER BY date) AS p FROM (SELECT key, date, value, value - lag(value) OVER (PARTITION BY key ORDER BY date) AS d FROM series)"""
NEEDS["ar"] = ("series",)


@query("k05_autoregression", _completed(ctes("ar", f="SELECT key, max(date) AS ld, arg_max(value, date) AS v0, arg_max(d, date) AS d0, regr_slope(d, p) AS phi, regr_intercept(d, p) AS c, sqrt(greatest(var_pop(d) FILTER (WHERE p IS NOT NULL) * (1 - regr_r2(d, p)), 0)) AS s FROM ar GROUP BY 1",
                                  p=f"SELECT key, ld, phi, c, s, 1 AS horizon, c + phi * d0 AS d, v0 + c + phi * d0 AS v FROM f UNION ALL SELECT key, ld, phi, c, s, horizon + 1, c + phi * d, v + c + phi * d FROM p WHERE horizon < {H}",
                                  x=f"SELECT *, {_DATE} AS date FROM p") + _out("v", "1.96 * s * sqrt(horizon)", "x", floor=False)))
def _(spark, sf):
    return _whole(fc.autoregressive(monthly(spark, sf), H), "autoregressive", spark, sf)


# order of differencing by the plain unit-root test, order of autoregression by Durbin and Levinson's recursion and the lowest AICc
SQL["dforder"] = """SELECT m.key, CASE WHEN t < -2.86 THEN 0 ELSE 1 END AS d FROM (SELECT DISTINCT key FROM series) m LEFT JOIN (
  SELECT key, CASE WHEN count(*) > 3 THEN regr_slope(s, p) / sqrt(var_pop(s) * (1 - regr_r2(s, p)) / (var_pop(p) * (count(*) - 2))) END AS t
  FROM (SELECT key, lag(value) OVER w AS p, value - lag(value) OVER w AS s FROM series WINDOW w AS (PARTITION BY key ORDER BY date)) WHERE p IS NOT NULL GROUP BY 1) USING (key)"""
NEEDS["dforder"] = ("series",)
_G = ", ".join(f"coalesce(sum(c * l{k}), 0) / count(c)" for k in range(6))
SQL["gammas"] = f"""SELECT key, max(d) AS d, count(c) AS n, [{_G}] AS g FROM (
  SELECT key, d, c, c AS l0, {", ".join(f"lag(c, {k}) OVER (PARTITION BY key ORDER BY date) AS l{k}" for k in range(1, 6))} FROM (
    SELECT key, d, date, x - avg(x) OVER (PARTITION BY key) AS c FROM (SELECT key, d, date, CASE WHEN d = 0 THEN value ELSE value - lag(value) OVER (PARTITION BY key ORDER BY date) END AS x FROM series JOIN dforder USING (key)))) GROUP BY 1"""
NEEDS["gammas"] = ("dforder",)
SQL["orders"] = """SELECT key, d, n, g, 0::BIGINT AS p, []::DOUBLE[] AS phi, g[1] AS v FROM gammas UNION ALL
  SELECT key, d, n, g, p + 1, list_append(list_transform(range(1, p + 1), lambda i: phi[i] - turn * phi[p - i + 1]), turn), v * (1 - turn * turn) FROM (
    SELECT *, (g[p + 2] - coalesce(list_sum(list_transform(range(1, p + 1), lambda i: phi[i] * g[p + 2 - i])), 0)) / v AS turn FROM orders WHERE p < 5)"""
NEEDS["orders"] = ("gammas",)


@query("k05_order_selection", ctes("orders", z="SELECT *, row_number() OVER (PARTITION BY key ORDER BY n * ln(v) + 2 * (p + 1) + 2 * (p + 1) * (p + 2) / (n - p - 2), p) AS rn FROM orders") +
       f"SELECT key, d::INTEGER AS d, p::INTEGER AS p, {r('ln(v)')} AS log_variance, {r('coalesce(phi[1], 0)')} AS first, {r('coalesce(phi[p], 0)')} AS last FROM z WHERE rn = 1")
def _(spark, sf):
    s = monthly(spark, sf)
    fit = kf.select_order(s, kf.differencing_order(s, 1, 0), 5)
    return tidy(fit.withColumn("log_variance", F.log("variance")).withColumn("first", F.coalesce(F.get("phi", 0), F.lit(0.0))).withColumn("last", F.coalesce(F.get("phi", F.size("phi") - 1), F.lit(0.0))),
                key="bigint", d="int", p="int", log_variance=6, first=6, last=6)


@query("k05_chosen_autoregression")
def _(spark, sf):
    return tidy(kf.autoregression(monthly(spark, sf), H), **OUT, reason="string")


@query("k05_autocorrelation", ctes("ar", c="SELECT key, date, d - avg(d) OVER (PARTITION BY key) AS c FROM ar WHERE d IS NOT NULL") + "\nUNION ALL ".join(
    f"SELECT key, {k}::INTEGER AS lag, {r('sum(c * l) / sum(c * c)')} AS acf FROM (SELECT key, c, lag(c, {k}) OVER (PARTITION BY key ORDER BY date) AS l FROM c) GROUP BY 1" for k in range(1, 7)))
def _(spark, sf):
    return tidy(fc.autocorrelation(monthly(spark, sf), 6), key="bigint", lag="int", acf=6)


@query("k06_seasonal_naive", _completed(ctes("series", "lastd", x=f"SELECT l.key, {_DATE} AS date, horizon, s FROM lastd l JOIN (SELECT key, stddev_pop(value) AS s FROM series GROUP BY 1) USING (key), {_STEPS}",
                                  y="SELECT x.*, t.value AS v FROM x JOIN series t ON t.key = x.key AND t.date = CAST(x.date - INTERVAL 12 MONTH AS DATE)") + _out("v", "1.96 * s", "y")))
def _(spark, sf):
    return _whole(fc.seasonal_naive(monthly(spark, sf), H), "seasonal_naive", spark, sf)


@query("k06_seasonal_autoregression", _completed(ctes("series", a="SELECT key, t, n, date, value, value - lag(value, 12) OVER (PARTITION BY key ORDER BY date) AS d FROM series",
                                           b="SELECT *, lag(d) OVER (PARTITION BY key ORDER BY date) AS p FROM a",
                                           f="SELECT key, max(date) AS ld, arg_max(d, date) AS d0, regr_slope(d, p) AS phi, regr_intercept(d, p) AS c, sqrt(greatest(var_pop(d) FILTER (WHERE p IS NOT NULL) * (1 - regr_r2(d, p)), 0)) AS s, list(value ORDER BY date) FILTER (WHERE t >= n - 12) AS w FROM b GROUP BY 1 HAVING regr_slope(d, p) IS NOT NULL",
                                           p=f"SELECT key, ld, phi, c, s, w, 1 AS horizon, c + phi * d0 AS d FROM f UNION ALL SELECT key, ld, phi, c, s, w, horizon + 1, c + phi * d FROM p WHERE horizon < {H}",
                                           x=f"SELECT *, {_DATE} AS date, w[horizon] + d AS v FROM p") + _out("v", "1.96 * s * sqrt(horizon)", "x", floor=False)))
def _(spark, sf):
    return _whole(fc.autoregressive(monthly(spark, sf), H, season=12), "autoregressive", spark, sf)


def yearly(spark, sf):
    return trade(spark, sf).select(F.col("id").alias("key"), F.make_date("year", F.lit(1), F.lit(1)).alias("date"), "value")


SQL["yearly"] = "SELECT id AS key, year, value, row_number() OVER (PARTITION BY id ORDER BY year) - 1 AS t FROM trade"
NEEDS["yearly"] = ("trade",)


@query("k07_bass_fit", ctes("yearly", a="SELECT key, value / sum(value) OVER (PARTITION BY key) AS y, sum(value) OVER (PARTITION BY key) AS top, coalesce(sum(value) OVER (PARTITION BY key ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER (PARTITION BY key) AS x FROM yearly",
                            m="SELECT key, max(top) AS top, avg(y) AS ym, avg(x) AS xm, avg(x * x) AS x2m, var_pop(x) AS v1, var_pop(x * x) AS v2, covar_pop(x, x * x) AS c12, covar_pop(y, x) AS c1, covar_pop(y, x * x) AS c2 FROM a GROUP BY 1",
                            b="SELECT key, top, ym, xm, x2m, (c1 * v2 - c2 * c12) / nullif(v1 * v2 - c12 * c12, 0) AS b1, (c2 * v1 - c1 * c12) / nullif(v1 * v2 - c12 * c12, 0) AS b2 FROM m",
                            c="SELECT key, top, ym - b1 * xm - b2 * x2m AS b0, b1, b2 FROM b", d="SELECT *, CASE WHEN b1 * b1 - 4 * b2 * b0 >= 0 THEN (-b1 - sqrt(greatest(b1 * b1 - 4 * b2 * b0, 0))) / nullif(2 * b2, 0) END AS mm FROM c") +
       f"SELECT key, {r('CASE WHEN mm > 0 THEN mm END', 4)} AS m_scaled, {r('CASE WHEN mm > 0 THEN b0 / mm END', 4)} AS p, {r('CASE WHEN mm > 0 THEN -mm * b2 END', 4)} AS q, CASE WHEN coalesce(mm > 0, false) THEN NULL ELSE 'no positive root' END AS reason FROM d")
def _(spark, sf):
    total = yearly(spark, sf).groupBy("key").agg(F.sum("value").alias("_t"))
    out = fc.fit_bass(yearly(spark, sf)).join(total, "key").withColumn("m_scaled", F.col("m") / F.col("_t"))
    return tidy(out, key="bigint", m_scaled=4, p=4, q=4, reason="string")


def _curve_sql(y: str, shape: str, b: str, c: str) -> str:
    return ctes("yearly", g="SELECT y.key, t, value, s, max(value) OVER (PARTITION BY y.key, s) * s AS a FROM yearly y, (VALUES (1.05::DOUBLE), (1.2), (1.5), (2.0), (3.0), (5.0)) v(s)",
                f=f"SELECT key, s, a, regr_slope({y}, t) AS k, regr_intercept({y}, t) AS i FROM g GROUP BY 1, 2, 3", p=f"SELECT key, s, a, {b} AS b, {c} AS c FROM f",
                e=f"SELECT p.key, p.s, p.a, p.b, p.c, sum((value - {shape}) ** 2) AS sse FROM p JOIN g ON g.key = p.key AND g.s = p.s GROUP BY ALL",
                z="SELECT *, row_number() OVER (PARTITION BY key ORDER BY sse, s) AS rn FROM e") + f"SELECT k.key, {r('a', 4)} AS a, {r('b', 4)} AS b, {r('c')} AS c, {r('sqrt(sse)', 2)} AS root_sse, CASE WHEN sse IS NULL THEN 'no fit on any level' END AS reason FROM (SELECT DISTINCT key FROM yearly) k LEFT JOIN z ON z.key = k.key AND rn = 1 AND sse IS NOT NULL"


def _curve(spark, sf, curve):
    s = yearly(spark, sf)
    fits = fc.every_key(fc.fit_curves(s, curve), s, "sse", "no fit on any level")
    return tidy(fits.withColumn("root_sse", F.sqrt("sse")), key="bigint", a=4, b=4, c=6, root_sse=2, reason="string")


@query("k08_gompertz_fit", _curve_sql("ln(-ln(value / a))", "p.a * exp(-p.b * exp(-p.c * t))", "exp(i)", "-k"))
def _(spark, sf):
    return _curve(spark, sf, "gompertz")


@query("k09_logistic_fit", _curve_sql("ln(value / (a - value))", "p.a / (1 + exp(-p.c * (t - p.b)))", "-i / nullif(k, 0)", "k"))
def _(spark, sf):
    return _curve(spark, sf, "logistic")


@query("k09_substitution", ctes("facts", y="SELECT id AS key, returned AS f, row_number() OVER (PARTITION BY id ORDER BY year) - 1 AS t FROM facts",
                                l="SELECT key, regr_slope(ln(f / (1 - f)), t) AS b, regr_intercept(ln(f / (1 - f)), t) AS a FROM y WHERE f > 0 AND f < 1 GROUP BY 1") +
       f"SELECT k.key, {r('CASE WHEN b IS NOT NULL THEN a END')} AS a, {r('b')} AS b, CASE WHEN b IS NULL THEN 'fewer than two shares between 0 and 1' END AS reason FROM (SELECT DISTINCT key FROM y) k LEFT JOIN l USING (key)")
def _(spark, sf):
    s = facts(spark, sf).select(F.col("id").alias("key"), F.make_date("year", F.lit(1), F.lit(1)).alias("date"), F.col("returned").alias("value"))
    return tidy(fc.every_key(fc.fit_substitution(s).where("b is not null"), s, "b", "fewer than two shares between 0 and 1"), key="bigint", a=6, b=6, reason="string")


@query("k10_exponential_trend", ctes("lines", x=_LX) + _out("exp(ll + rate * x)", _Z, "x"))
def _(spark, sf):
    return tidy(fc.exponential(monthly(spark, sf), H), **OUT)


@query("k10_quadratic_trend", ctes("lines", q="SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM lines",
                                   x=f"SELECT *, {_DATE} AS date, (n - 1 + horizon)::DOUBLE AS x FROM q, {_STEPS}").replace("x AS MATERIALIZED", "x AS MATERIALIZED") +
       f"SELECT key, date, CAST(horizon AS INTEGER) AS horizon, {r('greatest(ym - b1 * tm - b2 * t2m + b1 * x + b2 * x * x, 0)', 2)} AS value FROM x")
def _(spark, sf):
    return tidy(fc.quadratic(monthly(spark, sf), H), key="bigint", date="date", horizon="int", value=2)


@query("k10_conservative_growth", ctes("lastd", f=f"SELECT *, {_CAGR} AS c FROM lastd", x=f"SELECT key, horizon, {_DATE} AS date, lv * pow(1 + c * 0.7 / 100, horizon / 12.0) AS v FROM f, {_STEPS}") + _out("v", "abs(v) * 0.1", "x"))
def _(spark, sf):
    return tidy(fc.conservative(monthly(spark, sf), H), **OUT)


@query("k11_multi_phase", ctes("yearly", m="SELECT key, max(value) AS m FROM yearly GROUP BY 1") + f"""SELECT key, year, {r('0.6 * m / (1 + exp(-1.5 * (t - 1))) + 0.4 * m / (1 + exp(-0.8 * (t - 4)))', 4)} AS level,
  {r('0.6 * m * 1.5 * exp(-1.5 * (t - 1)) / (1 + exp(-1.5 * (t - 1))) ** 2 + 0.4 * m * 0.8 * exp(-0.8 * (t - 4)) / (1 + exp(-0.8 * (t - 4))) ** 2', 4)} AS rate FROM yearly JOIN m USING (key)""")
def _(spark, sf):
    from pyspark.sql import Window as W
    d = fc.indexed(yearly(spark, sf)).withColumn("m", F.max("value").over(W.partitionBy("key")))
    phases = [(0.6 * F.col("m"), F.lit(1.0), F.lit(1.5)), (0.4 * F.col("m"), F.lit(4.0), F.lit(0.8))]
    return tidy(d.withColumn("level", fc.multi_phase(F.col("t"), phases)).withColumn("rate", fc.multi_phase_rate(F.col("t"), phases)).withColumn("year", F.year("date")),
                key="bigint", year="int", level=4, rate=4)


@query("k11_generations", ctes("yearly", m="SELECT key, max(value) AS m FROM yearly GROUP BY 1",
                               f="SELECT key, year, m, (1 - exp(-0.43 * t)) / (1 + 0.4 / 0.03 * exp(-0.43 * t)) AS f1, CASE WHEN t <= 2 THEN 0 ELSE (1 - exp(-0.55 * (t - 2))) / (1 + 0.5 / 0.05 * exp(-0.55 * (t - 2))) END AS f2 FROM yearly JOIN m USING (key)") +
       f"SELECT key, year, {r('m * CASE WHEN f1 < 0 THEN 0 ELSE f1 END * (1 - f2)', 4)} AS first, {r('1.5 * m * f2', 4)} AS second FROM f")
def _(spark, sf):
    from pyspark.sql import Window as W
    d = fc.indexed(yearly(spark, sf)).withColumn("m", F.max("value").over(W.partitionBy("key")))
    one, two = fc.generations(F.col("t"), [(0.0, F.col("m"), F.lit(0.03), F.lit(0.4)), (2.0, 1.5 * F.col("m"), F.lit(0.05), F.lit(0.5))])
    return tidy(d.withColumn("first", one).withColumn("second", two).withColumn("year", F.year("date")), key="bigint", year="int", first=4, second=4)


@query("k12_boosted_trees")
def _(spark, sf):
    return fc.complete(fc.pooled(monthly(spark, sf), 3, learner="boosted", rounds=10), "pooled", monthly(spark, sf), 3)


SQL["hier"] = """SELECT h.market, h.id, h.year, h.value / lag(h.value) OVER (PARTITION BY h.market, h.id ORDER BY h.year) - 1 AS g, coalesce(m.region, 'Others') AS region, (h.id % 3)::INTEGER AS tier
  FROM history h LEFT JOIN mapping m ON m.name = h.name"""
NEEDS["hier"] = ("history", "mapping")
SQL["hg"] = """SELECT market, id, g / n AS own, n, mu, ge, te, mu + ge + te + (g / n - mu - ge - te) * (n / (n + 2.0)) AS growth FROM (
  SELECT *, sum(g - n * (mu + ge)) OVER (PARTITION BY market, tier) / sum(n) OVER (PARTITION BY market, tier) * (sum(n) OVER (PARTITION BY market, tier) / (sum(n) OVER (PARTITION BY market, tier) + 2.0)) AS te FROM (
  SELECT *, sum(g - n * mu) OVER (PARTITION BY market, region) / sum(n) OVER (PARTITION BY market, region) * (sum(n) OVER (PARTITION BY market, region) / (sum(n) OVER (PARTITION BY market, region) + 2.0)) AS ge FROM (
  SELECT *, sum(g) OVER (PARTITION BY market) / sum(n) OVER (PARTITION BY market) AS mu FROM (SELECT market, id, region, tier, sum(g) AS g, count(g)::DOUBLE AS n FROM hier WHERE g IS NOT NULL GROUP BY 1, 2, 3, 4))))"""
NEEDS["hg"] = ("hier",)


def _hier(spark, sf):
    from panelloom.operators.regions import add_region
    return fc.hierarchical_growth(add_region(history(spark, sf), mapping(spark, sf)).withColumn("tier", (F.col("id") % 3).cast("int")), "region", "tier")


@query("k13_hierarchical_growth", ctes("hg") + f"SELECT market, id, {r('mu')} AS mu, {r('ge')} AS group_effect, {r('te')} AS tier_effect, {r('growth')} AS growth FROM hg")
def _(spark, sf):
    return tidy(_hier(spark, sf), market="string", id="bigint", mu=6, group_effect=6, tier_effect=6, growth=6)


@query("k13_hierarchical_shares", ctes("hg", "now", x="SELECT s.market, s.id, CAST(s.year + h AS INTEGER) AS year, s.market_share * pow(1 + growth, h) AS v FROM now s JOIN hg USING (market, id), range(1, 4) g(h)") +
       f"SELECT market, id, year, {r('v / sum(v) OVER (PARTITION BY market, year) * 100')} AS market_share FROM x")
def _(spark, sf):
    latest = latest_slice(sh.market_shares(history(spark, sf)))
    return tidy(fc.hierarchical_shares(latest, _hier(spark, sf), 3), market="string", id="bigint", year="int", market_share=6)


@query("k14_vector_autoregression", ctes("facts", l="SELECT id, year, market_value / 1e6 AS v, lines / 100 AS n, lag(market_value / 1e6) OVER w AS a, lag(lines / 100) OVER w AS b FROM facts WINDOW w AS (PARTITION BY id ORDER BY year)",
                                         m="SELECT id, arg_max(v, year) AS lv, arg_max(n, year) AS ln, " + ", ".join(f"{e} FILTER (WHERE a IS NOT NULL) AS {k}" for e, k in (
                                             ("avg(v)", "vm"), ("avg(n)", "nm"), ("avg(a)", "am"), ("avg(b)", "bm"), ("var_pop(a)", "va"), ("var_pop(b)", "vb"), ("covar_pop(a, b)", "ab"), ("covar_pop(v, a)", "pa"), ("covar_pop(v, b)", "pb"), ("covar_pop(n, a)", "na"), ("covar_pop(n, b)", "nb"))) + " FROM l GROUP BY 1",
                                         c="SELECT *, (pa * vb - pb * ab) / (va * vb - ab * ab) AS p1, (pb * va - pa * ab) / (va * vb - ab * ab) AS p2, (na * vb - nb * ab) / (va * vb - ab * ab) AS n1, (nb * va - na * ab) / (va * vb - ab * ab) AS n2 FROM m") +
       f"SELECT id AS key, {r('vm - p1 * am - p2 * bm + p1 * lv + p2 * ln', 4)} AS next_first, {r('nm - n1 * am - n2 * bm + n1 * lv + n2 * ln', 4)} AS next_second FROM c")
def _(spark, sf):
    d = facts(spark, sf).select(F.col("id").alias("key"), "year", (F.col("market_value") / 1e6).alias("v"), (F.col("lines") / 100).alias("n"))
    return tidy(fc.forecast_var(fc.fit_var(d, "v", "n", "key", "year")), key="bigint", next_first=4, next_second=4)


@query("k15_fallback", ctes("lines", "lastd", f="SELECT l.*, lv, fv, fd FROM lines l JOIN (SELECT key, lv, fv, fd FROM lastd) USING (key)", c=f"SELECT *, {_CAGR} AS c FROM f",
                            x=f"SELECT *, {_DATE} AS date, (n - 1 + horizon)::DOUBLE AS x FROM c, {_STEPS}") +
       f"SELECT key, date, CASE WHEN key % 3 = 0 THEN 'fallback' ELSE 'cagr' END AS model, CAST(horizon AS INTEGER) AS horizon, {r('CASE WHEN key % 3 = 0 THEN greatest(a + b * x, 0) ELSE greatest(lv * pow(1 + c / 100, horizon / 12.0), 0) END', 4)} AS value FROM x")
def _(spark, sf):
    s = monthly(spark, sf)
    return tidy(fc.with_fallback(fc.cagr(s, H).where("key % 3 <> 0"), s, H), key="bigint", date="date", model="string", horizon="int", value=4)


@query("k15_evaluate", ctes("monthly", "hlines", x=_LX.replace("FROM lines", "FROM hlines"), j="SELECT m.value AS actual, greatest(a + b * x.x, 0) AS forecast FROM x JOIN monthly m ON m.key = x.key AND m.date = x.date") +
       f"SELECT 'linear' AS model, {r('avg(abs(actual - forecast))', 4)} AS mae, {r('avg(abs(actual - forecast) / abs(actual)) * 100')} AS mape, {r('sqrt(avg((actual - forecast) ** 2))', 4)} AS rmse FROM j")
def _(spark, sf):
    history, later = held(months(spark, sf))
    return tidy(fc.evaluate(fc.linear(history, H), later), model="string", mae=4, mape=6, rmse=4)


@query("k16_registry_run", ctes("lines", "lastd", x=_LX) + f"""SELECT 'linear' AS model, count(*)::BIGINT AS n, {r('sum(greatest(a + b * x, 0))', 2)} AS total FROM x
  UNION ALL SELECT 'naive', count(*)::BIGINT, {r('sum(lv)', 2)} FROM lastd, {_STEPS} UNION ALL SELECT 'exponential', count(*)::BIGINT, {r('sum(exp(ll + rate * x))', 2)} FROM x""")
def _(spark, sf):
    out = fc.forecast_many(monthly(spark, sf), ["linear", "Last value", "exponential"], H)
    return tidy(out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), model="string", n="bigint", total=2)
