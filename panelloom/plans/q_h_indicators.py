"""Indicators."""

from pyspark.sql import functions as F

from panelloom.functions import stats
from panelloom.functions.session import cut_lineage
from panelloom.operators import indicators as ind, keyed_fits as kf, shares as sh, warping as wp
from panelloom.plans.base import INDICATORS, NEEDS, SQL, ctes, facts, history, indicators, money, monthly, query, r, sql_uniform, table, tidy
from panelloom.plans import q_j_regimes as qj

NAMES = list(INDICATORS)
IY = dict(id="bigint", year="int")


@query("h01_panel_build", ctes("facts") + f"SELECT f.id, f.year, {r('market_value', 2)} AS market_value, {', '.join(f'{r(n)} AS {n}' for n in NAMES)}, {r('s_acctbal', 2)} AS balance FROM facts f LEFT JOIN supplier ON s_suppkey = f.id")
def _(spark, sf):
    i = indicators(spark, sf)
    ranks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    out = ind.build_panel(facts(spark, sf).select("id", "year", "market_value"), i, ranks, NAMES)
    return tidy(out, **IY, market_value=2, **{n: 6 for n in NAMES}, balance=2)


@query("h02_fill", ctes("facts", x="SELECT id, year, CASE WHEN lines >= 80 THEN discount END AS v FROM facts") + f"""SELECT id, year, {r('''coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS v FROM x""")
def _(spark, sf):
    d = facts(spark, sf).select("id", "year", F.when(F.col("lines") >= 80, F.col("discount")).alias("v"))
    return tidy(ind.fill(d, ["v"], ["id"]), **IY, v=6)


@query("h03_pearson", ctes("indicators") + f"SELECT indicator, count(*)::BIGINT AS n, {r('corr(value, market_value)')} AS pearson, {r('corr(value, market_value) * sqrt((count(*) - 2) / (1 - corr(value, market_value) ** 2))', 4)} AS t FROM indicators GROUP BY 1")
def _(spark, sf):
    return tidy(ind.pearson(indicators(spark, sf), ["indicator"]), indicator="string", n="bigint", pearson=6, t=4)


@query("h04_spearman", ctes("indicators", k="SELECT indicator, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY indicator ORDER BY market_value) + (count(*) OVER (PARTITION BY indicator, market_value) - 1) / 2.0 AS b FROM indicators") +
       f"SELECT indicator, {r('corr(a, b)')} AS spearman FROM k GROUP BY 1")
def _(spark, sf):
    return tidy(stats.spearman(indicators(spark, sf), ["indicator"], "value", "market_value"), indicator="string", spearman=6)


@query("h05_kendall", ctes("indicators", p="SELECT a.indicator, sum(sign(a.value - b.value) * sign(a.market_value - b.market_value)) AS s, sum(CASE WHEN a.value = b.value THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.market_value = b.market_value THEN 1 ELSE 0 END) AS ty, count(*) AS n FROM indicators a JOIN indicators b ON a.indicator = b.indicator AND (a.id, a.year) < (b.id, b.year) GROUP BY 1") +
       f"SELECT indicator, {r('s / sqrt((n - tx)::DOUBLE * (n - ty))')} AS kendall FROM p")
def _(spark, sf):
    return tidy(stats.kendall(indicators(spark, sf), ["indicator"], "value", "market_value"), indicator="string", kendall=6)


# One step a diagonal; a cell outside the table, or in its first row or column, costs 1e300.
_SCALED = "list_transform({0}, lambda v: (v - list_min({0})) / (list_max({0}) - list_min({0}) + 1e-8))"


def warp_sql(source: str, key: str, order: str, x: str, y: str) -> dict[str, str]:
    """Steps ``p``, ``s``, ``g`` and ``w`` (key, n, s) of the warping of two columns of a source."""
    inf = "1e300::DOUBLE"
    return dict(p=f"SELECT {key}, list({x} ORDER BY {order}) AS a, list({y} ORDER BY {order}) AS b, count(*)::BIGINT AS n FROM {source} GROUP BY ALL",
                s=f"SELECT {key}, n, {_SCALED.format('a')} AS a, {_SCALED.format('b')} AS b FROM p",
                g=f"""SELECT {key}, n, a, b, 1::BIGINT AS k, list_transform(range(1, n + 1), lambda i: {inf}) AS one, list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN abs(a[1] - b[1]) ELSE {inf} END) AS two FROM s
    UNION ALL SELECT {key}, n, a, b, k + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i >= 2 AND k + 3 - i BETWEEN 2 AND n THEN abs(a[i] - b[k + 3 - i]) + least(one[i], one[i - 1], two[i - 1]) ELSE {inf} END), one FROM g WHERE k < 2 * (n - 1)""",
                w=f"SELECT {key}, n, greatest(least(1 - (CASE WHEN n = 1 THEN two[1] ELSE one[n] END) / (2 * n), 1), -1) AS s FROM g WHERE k = greatest(2 * (n - 1), 1)")


@query("h06_warping_similarity", ctes("indicators", **warp_sql("indicators", "id, indicator", "year", "value", "market_value")) + f"SELECT id, indicator, {r('s')} AS similarity FROM w")
def _(spark, sf):
    return tidy(ind.warping_similarity(indicators(spark, sf), ["id", "indicator"], "year", "value", "market_value"), id="bigint", indicator="string", similarity=6)


def months(spark, sf):
    """(key, date, value, returned): value of a supplier's month and share of its lines that came back."""
    l = table(spark, sf, "lineitem")
    return l.groupBy(F.col("l_suppkey").alias("key"), F.trunc("l_shipdate", "month").alias("date")).agg(
        money("l_extendedprice").alias("value"), (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)).cast("double")).alias("returned"))


_WARP = ctes(m="""SELECT l_suppkey AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS returned FROM lineitem GROUP BY 1, 2""", **warp_sql("m", "key", "date", "value", "returned"))


@query("h06_warping_months", _WARP + f"SELECT key, n, {r('s')} AS similarity FROM w")
def _(spark, sf):
    return tidy(wp.similarities(months(spark, sf), ["key"], "date", "value", "returned"), key="bigint", n="bigint", similarity=6)


@query("h06_warping_at_least", _WARP + f"SELECT key, n, CASE WHEN s >= 0.94 THEN {r('s')} END AS similarity, s < 0.94 AS below FROM w")
def _(spark, sf):
    return tidy(wp.similarities(months(spark, sf), ["key"], "date", "value", "returned", at_least=0.94), key="bigint", n="bigint", similarity=6, below="boolean")


SQL["lagc"] = " UNION ALL ".join(
    f"SELECT indicator, {k} AS lag, coalesce(corr(value, y), 0) AS c, count(y) AS n FROM (SELECT indicator, value, {'lead' if k >= 0 else 'lag'}(market_value, {abs(k)}) OVER (PARTITION BY id, indicator ORDER BY year) AS y FROM indicators) GROUP BY 1" for k in range(-5, 6))
NEEDS["lagc"] = ("indicators",)


@query("h07_lagged_correlation", ctes("lagc") + f"SELECT indicator, lag::INTEGER AS lag, {r('c')} AS correlation, n::BIGINT AS n FROM lagc")
def _(spark, sf):
    return tidy(ind.lagged(indicators(spark, sf), 5), indicator="string", lag="int", correlation=6, n="bigint")


@query("h07_best_lag", ctes("lagc", k="SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY abs(c) DESC) AS rn FROM lagc") + f"SELECT indicator, lag::INTEGER AS best_lag, {r('c')} AS correlation FROM k WHERE rn = 1")
def _(spark, sf):
    return tidy(ind.best_lag(ind.lagged(indicators(spark, sf), 5)), indicator="string", best_lag="int", correlation=6)


SQL["roll"] = """SELECT key, indicator, date, CASE WHEN count(*) OVER w = 12 THEN corr(x, value) OVER w END AS rc FROM series JOIN mind USING (key, date) WINDOW w AS (PARTITION BY key, indicator ORDER BY date ROWS 11 PRECEDING)"""
NEEDS["roll"] = ("series", "mind")


def roll(spark, sf):
    j = monthly(spark, sf).join(qj.mind(spark, sf).withColumnRenamed("value", "x"), ["key", "date"])
    return ind.rolling(j, ["key", "indicator"], "date", "x", "value")


@query("h08_rolling_correlation", ctes("roll") + f"SELECT key, indicator, date, {r('rc')} AS rolling_corr FROM roll")
def _(spark, sf):
    return tidy(roll(spark, sf), key="bigint", indicator="string", date="date", rolling_corr=6)


@query("h08_rolling_summary", ctes("roll", n="SELECT *, row_number() OVER (PARTITION BY key, indicator ORDER BY date) AS i FROM roll WHERE rc IS NOT NULL", s="SELECT indicator, key, regr_slope(rc, i) AS s FROM n GROUP BY 1, 2",
                                   a="SELECT indicator, avg(rc) AS m, stddev_samp(rc) AS d FROM n GROUP BY 1") + f"SELECT indicator, {r('m')} AS mean, {r('d')} AS std, {r('1 - d / (abs(m) + 1e-8)', 4)} AS stability, {r('(SELECT avg(s) FROM s WHERE s.indicator = a.indicator)')} AS trend FROM a")
def _(spark, sf):
    return tidy(ind.rolling_summary(cut_lineage(roll(spark, sf)), ["indicator"], ["key", "indicator"], "date"), indicator="string", mean=6, std=6, stability=4, trend=6)


@query("h09_information_weights", ctes("indicators", f="SELECT indicator, count(*)::DOUBLE AS n, var_pop(market_value) * (1 - regr_r2(market_value, value)) AS mse FROM indicators GROUP BY 1", g="SELECT *, 4 - 2 * (-0.5 * n * ln(2 * pi() * mse) - n / 2) AS aic FROM f") +
       f"SELECT indicator, {r('aic', 4)} AS aic, {r('(1 / (1 + aic)) / sum(1 / (1 + aic)) OVER ()')} AS weight FROM g")
def _(spark, sf):
    return tidy(ind.information_weights(indicators(spark, sf)), indicator="string", aic=4, weight=6)


@query("h10_forest_weights")
def _(spark, sf):
    return ind.forest_weights(facts(spark, sf), NAMES)


SQL["blend"] = """SELECT a.indicator, c, st, mi, 0.4 * c + 0.3 * mi + 0.3 * st AS w FROM (SELECT indicator, coalesce(abs(corr(value, market_value)), 0) AS c, 1 / (1 + stddev_samp(value) / (abs(avg(value)) + 1e-8)) AS st FROM indicators GROUP BY 1) a JOIN (
  SELECT indicator, sum(p / t * ln(p * t / (px * py))) AS mi FROM (SELECT *, sum(p) OVER (PARTITION BY indicator) AS t, sum(p) OVER (PARTITION BY indicator, bx) AS px, sum(p) OVER (PARTITION BY indicator, by_) AS py FROM (
    SELECT indicator, bx, by_, count(*)::DOUBLE AS p FROM (SELECT indicator, least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 10), 9) AS bx,
      least(floor((market_value - min(market_value) OVER w) / (max(market_value) OVER w - min(market_value) OVER w) * 10), 9) AS by_ FROM indicators WINDOW w AS (PARTITION BY indicator)) GROUP BY 1, 2, 3)) GROUP BY 1) b USING (indicator)"""
NEEDS["blend"] = ("indicators",)


@query("h11_blend_weights", ctes("blend") + f"SELECT indicator, {r('c')} AS correlation, {r('mi')} AS mutual_information, {r('st')} AS stability, {r('w / sum(w) OVER ()')} AS weight FROM blend")
def _(spark, sf):
    return tidy(ind.blend_weights(indicators(spark, sf)), indicator="string", correlation=6, mutual_information=6, stability=6, weight=6)


@query("h12_ensemble_weights")
def _(spark, sf):
    i = cut_lineage(indicators(spark, sf))
    return ind.ensemble_weights(ind.information_weights(i), ind.forest_weights(facts(spark, sf), NAMES), ind.blend_weights(i))


_F = "PARTITION BY key ORDER BY date"


@query("h13_features", ctes("series") + f"SELECT key, date, {r(f'CASE WHEN t >= 2 THEN avg(value) OVER ({_F} ROWS 2 PRECEDING) END', 4)} AS ma3, {r(f'CASE WHEN t >= 11 THEN avg(value) OVER ({_F} ROWS 11 PRECEDING) END', 4)} AS ma12, "
       f"{r(f'CASE WHEN t >= 5 THEN stddev_samp(value) OVER ({_F} ROWS 5 PRECEDING) END', 4)} AS vol6, {r(f'value - 2 * lag(value) OVER ({_F}) + lag(value, 2) OVER ({_F})', 3)} AS acceleration, {r(f'value / lag(value, 3) OVER ({_F}) - 1')} AS momentum3, "
       f"{r('(value - avg(value) OVER (PARTITION BY key)) / (stddev_samp(value) OVER (PARTITION BY key) + 1e-8)')} AS zscore, {r('(rank() OVER (PARTITION BY key ORDER BY value) + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0) / count(*) OVER (PARTITION BY key)')} AS rank FROM series")
def _(spark, sf):
    return tidy(ind.features(monthly(spark, sf), ["key"], "date"), key="bigint", date="date", ma3=4, ma12=4, vol6=4, acceleration=3, momentum3=6, zscore=6, rank=6)


SQL["df1"] = "SELECT key, t, value - lag(value) OVER (PARTITION BY key ORDER BY t) AS d FROM series"
NEEDS["df1"] = ("series",)
SQL["adf"] = """SELECT key, regr_slope(dd, p) / sqrt(var_pop(dd) * (1 - regr_r2(dd, p)) / (var_pop(p) * (count(*) - 2))) AS t FROM (SELECT key, lag(d) OVER (PARTITION BY key ORDER BY t) AS p, d - lag(d) OVER (PARTITION BY key ORDER BY t) AS dd FROM df1 WHERE d IS NOT NULL) WHERE dd IS NOT NULL GROUP BY 1"""
NEEDS["adf"] = ("df1",)


@query("h14_unit_root", ctes("adf") + f"SELECT key, {r('t', 4)} AS t, t < -2.86 AS stationary FROM adf")
def _(spark, sf):
    from pyspark.sql import Window as W
    d = monthly(spark, sf).withColumn("d", F.col("value") - F.lag("value").over(W.partitionBy("key").orderBy("date"))).where("d is not null")
    return tidy(ind.unit_root(d, ["key"], "date", "d"), key="bigint", t=4, stationary="boolean")


@query("h14_lagged_unit_root")
def _(spark, sf):
    return tidy(kf.unit_root_lags(monthly(spark, sf), ["key"], "date"), key="bigint", n="bigint", lags="int", t=4, stationary="boolean")


@query("h14_stationary", ctes("adf") + f"""SELECT key, t::BIGINT AS step, 'diff' AS method, {r('CASE WHEN (SELECT a.t FROM adf a WHERE a.key = df1.key) < -2.86 THEN d ELSE d - lag(d) OVER (PARTITION BY key ORDER BY t) END', 3)} AS v FROM df1
  UNION ALL SELECT key, t, 'log_diff', {r('ln(value) - ln(lag(value) OVER (PARTITION BY key ORDER BY t))')} FROM series
  UNION ALL SELECT key, t, 'detrend', {r('value - avg(value) OVER w - regr_slope(value, t) OVER w * (t - avg(t) OVER w)', 1)} FROM series WINDOW w AS (PARTITION BY key)""")
def _(spark, sf):
    from panelloom.operators.forecast import indexed
    s = indexed(monthly(spark, sf))
    out = None
    for m, d in (("diff", 3), ("log_diff", 6), ("detrend", 1)):
        x = ind.stationary(s, ["key"], "date", m).select("key", F.col("t").cast("bigint").alias("step"), F.lit(m).alias("method"), F.round("stationary_value", d).alias("v"))
        out = x if out is None else out.unionByName(x)
    return tidy(out, key="bigint", step="bigint", method="string", v=6)


@query("h15_collinearity")
def _(spark, sf):
    return ind.drop_collinear(facts(spark, sf), [*NAMES, "market_value"])[1]


_P = " + ".join(f"(u >= {p})::INT" for p in ind.POISSON)
SQL["boot"] = f"""SELECT indicator, rep, (sum(w) * sum(w * a * b) - sum(w * a) * sum(w * b)) / sqrt((sum(w) * sum(w * a * a) - sum(w * a) ** 2) * (sum(w) * sum(w * b * b) - sum(w * b) ** 2)) AS rr FROM (
  SELECT indicator, rep, value AS a, market_value AS b, ({_P})::DOUBLE AS w FROM (SELECT *, {sql_uniform('indicator', 'id', 'year', 'rep')} AS u FROM indicators, range(1, 21) g(rep))) GROUP BY 1, 2"""
NEEDS["boot"] = ("indicators",)


@query("h16_bootstrap", ctes("boot") + f"SELECT indicator, {r('avg(rr)')} AS mean, {r('stddev_pop(rr)')} AS std, {r('quantile_cont(rr, 0.025)')} AS lower, {r('quantile_cont(rr, 0.975)')} AS upper, {r('least(greatest(1 - stddev_pop(rr) / (abs(avg(rr)) + 1e-8), 0), 1)', 4)} AS confidence FROM boot GROUP BY 1")
def _(spark, sf):
    return tidy(ind.bootstrap(indicators(spark, sf), ["indicator"], ["id", "year"], "value", "market_value", 20), indicator="string", mean=6, std=6, lower=6, upper=6, confidence=4)


SQL["score"] = """SELECT id, least(greatest(exp(sum(ln(1 + w * (0.75 + v / (v + 1) * 0.5 - 1)))), 0.5), 1.5) AS score FROM (SELECT id, indicator, arg_max(value, year) AS v FROM indicators GROUP BY 1, 2) JOIN (SELECT indicator, w / sum(w) OVER () AS w FROM blend) USING (indicator) GROUP BY 1"""
NEEDS["score"] = ("indicators", "blend")


@query("h17_adjust_shares", ctes("shares", "score", x="SELECT market, s.id, year, market_share * coalesce(score, 1) AS v FROM shares s LEFT JOIN score USING (id)") + f"SELECT market, id, year, {r('v / sum(v) OVER (PARTITION BY market, year) * 100')} AS market_share FROM x")
def _(spark, sf):
    i = indicators(spark, sf)
    out = ind.adjust_shares(sh.market_shares(history(spark, sf)), ind.entity_scores(i, ind.blend_weights(i), ["id"]))
    return tidy(out, market="string", id="bigint", year="int", market_share=6)


@query("h18_analysis_record")
def _(spark, sf):
    return ind.analysis_record(cut_lineage(indicators(spark, sf)), ["id", "year"])


@query("h19_levels", ctes("score") + f"SELECT id, {r('score')} AS score, CASE WHEN score >= 1.3 THEN 'Very Positive' WHEN score >= 1.1 THEN 'Positive' WHEN score >= 0.9 THEN 'Neutral' WHEN score >= 0.7 THEN 'Negative' ELSE 'Very Negative' END AS impact, "
       "CASE WHEN score - 0.95 >= 0.1 THEN 'Very High' WHEN score - 0.95 >= 0.05 THEN 'High' WHEN score - 0.95 >= 0.02 THEN 'Medium' WHEN score - 0.95 >= 0.01 THEN 'Low' ELSE 'Very Low' END AS influence FROM score")
def _(spark, sf):
    i = indicators(spark, sf)
    d = ind.entity_scores(i, ind.blend_weights(i), ["id"])
    return tidy(d.withColumn("impact", ind.impact_level("score")).withColumn("influence", ind.influence_level(F.col("score") - 0.95)), id="bigint", score=6, impact="string", influence="string")
