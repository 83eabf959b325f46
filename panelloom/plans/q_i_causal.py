"""Causal and intervention analysis."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage, with_row
from panelloom.functions.stats import critical_t
from panelloom.operators import causal as ca, indicators as ind, shares as sh, keyed_fits as kf, synthetic as sy
from panelloom.roles import Roles
from panelloom.plans.base import INDICATORS, NEEDS, SQL, ctes, facts, history, indicators, monthly, query, r, tidy
from panelloom.plans import q_h_indicators as qh, q_j_regimes as qj  # noqa: F401  (blend, mind inputs)

MONTHLY = Roles(id="key", year="date", by=())
VARS = [*INDICATORS, "market_value"]
SQL["pairs"] = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c, count(*) AS n FROM facts" for i, a in enumerate(VARS) for b in VARS[i + 1:])
NEEDS["pairs"] = ("facts",)


@query("i01_skeleton", ctes("pairs") + f"SELECT a, b, {r('c')} AS correlation, {r('abs(c)')} AS weight FROM pairs WHERE abs(c) > 0.1 AND abs(c * sqrt((n - 2) / (1 - c * c))) > {critical_t(0.05, 698)}")
def _(spark, sf):
    return tidy(ca.skeleton(facts(spark, sf), VARS), a="string", b="string", correlation=6, weight=6)


@query("i01_directed_edges", ctes("pairs") + f"SELECT a, b, {r('abs(c)')} AS weight FROM pairs WHERE abs(c) > 0.05 UNION ALL SELECT b, a, {r('abs(c)')} FROM pairs WHERE abs(c) > 0.05")
def _(spark, sf):
    return tidy(ca.directed_edges(facts(spark, sf), VARS, 0.05), a="string", b="string", weight=6)


@query("i02_partial_effect")
def _(spark, sf):
    return ca.partial_effect(facts(spark, sf), "lines", "market_value", ["discount", "quantity", "returned"], ["id", "year"])


@query("i03_nonlinear_gain")
def _(spark, sf):
    return ca.nonlinear_gain(facts(spark, sf), list(INDICATORS), "market_value")


@query("i04_forest_benefit")
def _(spark, sf):
    return ca.forest_benefit(facts(spark, sf), list(INDICATORS), "market_value", 5)


@query("i05_cusum", ctes("series", z="SELECT key, date, t, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM series WINDOW w AS (PARTITION BY key)",
                         f="SELECT key, date, t, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d FROM z WHERE t = 0 UNION ALL SELECT b.key, b.date, b.t, greatest(0, a.u + b.z - 0.5), least(0, a.d + b.z + 0.5) FROM f a JOIN z b ON b.key = a.key AND b.t = a.t + 1") +
       f"SELECT key, date, {r('u')} AS upper, {r('d')} AS lower, u > 2 OR abs(d) > 2 AS is_change FROM f")
def _(spark, sf):
    return tidy(ca.cusum(monthly(spark, sf)), key="bigint", date="date", upper=6, lower=6, is_change="boolean")


@query("i06_peaks", ctes("df1", d="SELECT key, t, abs(d) AS s FROM df1", q="SELECT key, quantile_cont(s, 0.9) AS q FROM d GROUP BY 1", n="SELECT *, lag(s) OVER (PARTITION BY key ORDER BY t) AS a, lead(s) OVER (PARTITION BY key ORDER BY t) AS b FROM d") +
       f"SELECT n.key, tr.date, {r('s', 3)} AS step FROM n JOIN q USING (key) JOIN series tr ON tr.key = n.key AND tr.t = n.t WHERE s > a AND s > b AND s >= q")
def _(spark, sf):
    return tidy(ca.peaks(monthly(spark, sf)), key="bigint", date="date", step=3)


@query("i06_variance_changes", ctes("series", v="SELECT key, date, n, CASE WHEN t >= 9 THEN var_samp(value) OVER (PARTITION BY key ORDER BY date ROWS 9 PRECEDING) END / 1e6 AS v FROM series", m="SELECT key, date, abs(v - lag(v) OVER (PARTITION BY key ORDER BY date)) AS m FROM v WHERE n >= 20",
                                    q="SELECT key, quantile_cont(m, 0.9) AS q FROM m GROUP BY 1") + f"SELECT key, date, {r('m', 3)} AS move FROM m JOIN q USING (key) WHERE m > q")
def _(spark, sf):
    return tidy(ca.variance_changes(monthly(spark, sf)).withColumn("move", F.col("move") / 1e6), key="bigint", date="date", move=3)


SQL["sc"] = """SELECT c.market, c.id, c.year, c.value AS cv, t.value AS tv FROM history c JOIN history t ON t.market = c.market AND t.year = c.year AND t.id = 1 WHERE c.id <> 1"""
NEEDS["sc"] = ("history",)
SQL["scw"] = "SELECT market, id, d, 1 / (sqrt(d) + 1e-8) / sum(1 / (sqrt(d) + 1e-8)) OVER (PARTITION BY market) AS w FROM (SELECT market, id, avg((cv - tv) ** 2) AS d FROM sc WHERE year < 1998 GROUP BY 1, 2)"
NEEDS["scw"] = ("sc",)
SQL["scp"] = "SELECT market, year, max(tv) AS tv, sum(w * cv) / sum(w) AS syn FROM sc JOIN scw USING (market, id) GROUP BY 1, 2"
NEEDS["scp"] = ("scw",)


@query("i07_synthetic_control", ctes("scp") + f"""SELECT market, {r('avg(tv - syn) FILTER (WHERE year >= 1998)', 2)} AS average_effect, {r('sum(tv - syn) FILTER (WHERE year >= 1998)', 2)} AS cumulative_effect,
  {r('1 - sum((tv - syn) ** 2) FILTER (WHERE year < 1998) / (var_pop(tv) FILTER (WHERE year < 1998) * count(*) FILTER (WHERE year < 1998))', 4)} AS pre_r2 FROM scp GROUP BY 1""")
def _(spark, sf):
    return tidy(ca.synthetic_control(history(spark, sf), 1, 1998)["effect"], market="string", average_effect=2, cumulative_effect=2, pre_r2=4)


@query("i07_control_path", ctes("scp") + f"SELECT market, year, {r('tv', 2)} AS treated, {r('syn', 2)} AS synthetic FROM scp")
def _(spark, sf):
    return tidy(ca.synthetic_control(history(spark, sf), 1, 1998)["path"], market="string", year="int", treated=2, synthetic=2)


@query("i07_fitted_control")
def _(spark, sf):
    return tidy(sy.fitted_control(history(spark, sf), 1, 1998)["effect"], market="string", average_effect=2, cumulative_effect=2, pre_r2=4)


@query("i07_fitted_months")
def _(spark, sf):
    months = monthly(spark, sf)
    middle = months.where("key = 1").agg(F.percentile(F.unix_date("date"), F.lit(0.75)).alias("d")).first()["d"]
    start = F.date_from_unix_date(F.lit(int(middle or 0)))
    return tidy(sy.fitted_control(months, 1, start, MONTHLY)["path"], date="date", treated=2, synthetic=2, effect=2)


def wide(spark, sf):
    return monthly(spark, sf).join(qj.mind(spark, sf).groupBy("key", "date").pivot("indicator", list(INDICATORS)).agg(F.first("value")), ["key", "date"])


_M = {f"{a}{b}": f"covar_pop({x}, {y}) OVER w" for a, x in (("t", "quantity"), ("y", "value"), ("z", "discount")) for b, y in (("t", "quantity"), ("y", "value"), ("z", "discount"))}
SQL["reff"] = "SELECT key, date, ty - tz * yz / zz AS ty, tt - tz * tz / zz AS tt, yy - yz * yz / zz AS yy FROM (SELECT key, date, count(*) OVER w AS n, " + ", ".join(f"{e} AS {k}" for k, e in _M.items()) + \
    " FROM series JOIN mfacts USING (key, date) WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE n = 12"
NEEDS["reff"] = ("series", "mfacts")


@query("i08_rolling_effect", ctes("reff") + f"SELECT key, date, {r('ty / tt', 2)} AS effect, {r('ty / sqrt(tt * yy)')} AS correlation FROM reff")
def _(spark, sf):
    return tidy(kf.rolling_effects(wide(spark, sf), "quantity", "value", ["discount"]), key="bigint", date="date", effect=2, correlation=6)


@query("i08_several_confounders")
def _(spark, sf):
    return tidy(kf.rolling_effects(wide(spark, sf), "quantity", "value", ["discount", "lines", "returned"]), key="bigint", date="date", effect=2, correlation=6, p_value=6)


@query("i09_variance_regimes", ctes("series", "mfacts", v="SELECT f.*, t.value, CASE WHEN count(*) OVER w = 6 THEN var_samp(t.value) OVER w END AS v FROM series t JOIN mfacts f USING (key, date) WINDOW w AS (PARTITION BY key ORDER BY date ROWS 5 PRECEDING)",
                                    q="SELECT key, median(v) AS q FROM v GROUP BY 1", s="SELECT v.*, (v.v > q.q)::INT AS regime FROM v JOIN q USING (key) WHERE v.v IS NOT NULL") +
       f"SELECT regime::INTEGER AS regime, count(*)::BIGINT AS n, {r('avg(value)', 2)} AS mean, {r('var_samp(value) / 1e6', 2)} AS variance, {r('corr(lines, value)')} AS corr_lines, {r('corr(quantity, value)')} AS corr_quantity FROM s GROUP BY 1")
def _(spark, sf):
    out = ca.variance_regimes(wide(spark, sf), "value", ["lines", "quantity"]).withColumn("variance", F.col("variance") / 1e6)
    return tidy(out, regime="int", n="bigint", mean=2, variance=2, corr_lines=6, corr_quantity=6)


SQL["evid"] = """SELECT indicator, c AS pc_weight, mi AS gain, st AS stab, least(1, greatest(0, c / 2 * 0.2 + CASE WHEN c > 0.05 THEN c * 0.3 ELSE 0 END + mi * 0.2 + st * 0.15)) AS strength FROM blend"""
NEEDS["evid"] = ("blend",)


def evidence(spark, sf):
    b = ind.blend_weights(indicators(spark, sf))
    c = F.col("correlation")
    return ca.composite_strength(b.select("indicator", "weight", c.alias("pc_weight"), F.lit(0.0).alias("order_weight"), (c > 0.05).alias("significant"), c.alias("effect"), F.col("mutual_information").alias("nonlinear_gain"),
                                          F.lit(0.0).alias("kernel_benefit"), F.lit(0).alias("interventions"), F.lit(0.0).alias("intervention_effect"), F.lit(1).alias("significant_periods"), F.col("stability").alias("effect_stability")))


@query("i10_composite_strength", ctes("evid") + f"SELECT indicator, {r('strength')} AS strength FROM evid")
def _(spark, sf):
    return tidy(evidence(spark, sf), indicator="string", strength=6)


@query("i10_adjust_shares", ctes("shares", "indicators", "evid", w0="SELECT indicator, 0.3 * b.w / sum(b.w) OVER () + 0.7 * strength AS w FROM blend b JOIN evid USING (indicator)", w1="SELECT indicator, w / sum(w) OVER () AS w FROM w0",
                                 s="SELECT id, least(greatest(exp(sum(ln(1 + w * (0.75 + v / (v + 1) * 0.5 - 1)))), 0.5), 1.5) AS score FROM (SELECT id, indicator, arg_max(value, year) AS v FROM indicators GROUP BY 1, 2) JOIN w1 USING (indicator) GROUP BY 1",
                                 x="SELECT market, h.id, year, market_share * coalesce(score, 1) AS v FROM shares h LEFT JOIN s USING (id)") + f"SELECT market, id, year, {r('v / sum(v) OVER (PARTITION BY market, year) * 100')} AS market_share FROM x")
def _(spark, sf):
    e = cut_lineage(evidence(spark, sf))
    out = ca.adjust_shares(sh.market_shares(history(spark, sf)), indicators(spark, sf), e.select("indicator", "weight"), e.select("indicator", "strength"))
    return tidy(out, market="string", id="bigint", year="int", market_share=6)


@query("i11_causal_analysis")
def _(spark, sf):
    parts = ca.analysis(cut_lineage(facts(spark, sf)), list(INDICATORS), "market_value", ["id", "year"], ("discovery", "effects"))
    return parts["edges"].agg(F.count(F.lit(1)).alias("edges")).transform(with_row, parts["effect"])
