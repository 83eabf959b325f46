"""Regimes, market conditions and adaptive weights."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage, dealt
from panelloom.functions.stats import critical_t
from panelloom.operators import regimes as rg
from panelloom.plans.base import INDICATORS, NEEDS, SQL, ctes, money, monthly, query, r, table, tidy
from panelloom.plans import q_l_ensemble as ql
from panelloom.plans.q_k_forecast import months

WIN = 12
KD = dict(key="bigint", date="date")
SQL["mfacts"] = """SELECT l_suppkey AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS lines, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS discount,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS quantity, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS returned FROM lineitem GROUP BY 1, 2"""
SQL["mind"] = " UNION ALL ".join(f"SELECT key, date, '{i}' AS indicator, {i} AS x FROM mfacts" for i in INDICATORS)
NEEDS["mind"] = ("mfacts",)


def mind(spark, sf):
    n = F.count(F.lit(1)).cast("double")
    wide = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.trunc("l_shipdate", "month").alias("date"))
            .agg(n.alias("lines"), (money("l_discount") / n).alias("discount"), (money("l_quantity") / n).alias("quantity"), (F.count_if(F.col("l_returnflag") == "R") / n).alias("returned")))
    return wide.unpivot(["key", "date"], list(INDICATORS), "indicator", "value")


SQL["met"] = f"""SELECT key, date, t, n, value, g, CASE WHEN count(g) OVER f = {WIN} THEN stddev_samp(g) OVER f END AS vol, CASE WHEN count(g) OVER f = {WIN} THEN avg(g) OVER f END AS mom,
  CASE WHEN count(value) OVER f = {WIN} THEN abs(corr(t, value) OVER f) END AS ts, CASE WHEN count(value) OVER f = {WIN} THEN value / avg(value) OVER f END AS sr
  FROM (SELECT *, value / lag(value) OVER (PARTITION BY key ORDER BY date) - 1 AS g FROM series) WINDOW f AS (PARTITION BY key ORDER BY date ROWS {WIN - 1} PRECEDING)"""
NEEDS["met"] = ("series",)
SQL["cand"] = f"""SELECT key, date, row_number() OVER w AS i, CASE WHEN count(vol) OVER nx = {WIN} AND count(vol) OVER pv = {WIN} AND count(vol) OVER nn = {WIN + 1}
  THEN abs(avg(vol) OVER nx - avg(vol) OVER pv) / nullif(sqrt((var_samp(vol) OVER nx + var_samp(vol) OVER pv) / 2), 0) > 1.5 ELSE false END AS c FROM met WHERE vol IS NOT NULL
  WINDOW w AS (PARTITION BY key ORDER BY date), nx AS (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND {WIN - 1} FOLLOWING), pv AS (PARTITION BY key ORDER BY date ROWS BETWEEN {WIN} PRECEDING AND 1 PRECEDING),
  nn AS (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND {WIN} FOLLOWING)"""
NEEDS["cand"] = ("met",)
SQL["cp"] = """SELECT key, date, i, coalesce(c, false) AS keep, CASE WHEN coalesce(c, false) THEN i ELSE -6 END AS last FROM cand WHERE i = 1 UNION ALL
  SELECT b.key, b.date, b.i, coalesce(b.c, false) AND b.i - a.last >= 6, CASE WHEN coalesce(b.c, false) AND b.i - a.last >= 6 THEN b.i ELSE a.last END FROM cp a JOIN cand b ON b.key = a.key AND b.i = a.i + 1"""
NEEDS["cp"] = ("cand",)
SQL["rows"] = """SELECT m.*, coalesce(keep, false) AS chg, sum(coalesce(keep, false)::INT) OVER (PARTITION BY m.key ORDER BY m.date) AS rid FROM met m LEFT JOIN cp ON cp.key = m.key AND cp.date = m.date"""
NEEDS["rows"] = ("cp",)
SQL["regs"] = """SELECT key, rid, count(*) AS len, avg(g) AS mg, stddev_samp(g) AS gv, avg(vol) AS mv, max(vol) AS xv, avg(mom) AS mm, avg(ts) AS mt FROM rows GROUP BY 1, 2"""
NEEDS["regs"] = ("rows",)
SQL["typed"] = """SELECT *, CASE WHEN coalesce(mg, 0) > 0.02 AND coalesce(gv, 0) < 0.1 THEN 'stable_growth' WHEN coalesce(mg, 0) > 0.02 THEN 'volatile_growth' WHEN abs(coalesce(mg, 0)) <= 0.02 AND coalesce(mv, 0) < 0.05 THEN 'stable'
  WHEN abs(coalesce(mg, 0)) <= 0.02 THEN 'volatile_stable' ELSE 'decline' END AS typ FROM regs"""
NEEDS["typed"] = ("regs",)


def rows(spark, sf):
    return rg.with_regimes(rg.change_points(rg.market_metrics(monthly(spark, sf), WIN), WIN, 1.5, 6))


def typed(spark, sf):
    d = cut_lineage(rows(spark, sf))
    return d.join(rg.regime_table(d).select("key", "regime_id", "regime_type"), ["key", "regime_id"])


@query("j01_market_metrics", ctes("met") + f"SELECT key, date, {r('g')} AS growth, {r('vol')} AS volatility, {r('mom')} AS momentum, {r('ts')} AS trend_strength, {r('sr')} AS size_relative FROM met")
def _(spark, sf):
    return tidy(rg.market_metrics(monthly(spark, sf), WIN), **KD, growth=6, volatility=6, momentum=6, trend_strength=6, size_relative=6)


@query("j02_change_points", ctes("rows") + "SELECT key, date, chg AS is_change FROM rows")
def _(spark, sf):
    return tidy(rg.change_points(rg.market_metrics(monthly(spark, sf), WIN), WIN, 1.5, 6), **KD, is_change="boolean")


@query("j03_regime_table", ctes("typed") + f"SELECT key, rid::BIGINT AS regime_id, len::BIGINT AS length, {r('mg')} AS mean_growth, {r('gv')} AS growth_volatility, {r('mv')} AS mean_volatility, {r('mm')} AS mean_momentum, {r('mt')} AS mean_trend_strength, typ AS regime_type FROM typed")
def _(spark, sf):
    return tidy(rg.regime_table(cut_lineage(rows(spark, sf))), key="bigint", regime_id="bigint", length="bigint", mean_growth=6, growth_volatility=6, mean_volatility=6, mean_momentum=6, mean_trend_strength=6, regime_type="string")


SQL["perfr"] = """SELECT typ, indicator, coalesce(corr(value, x), 0) AS c, count(*) AS n FROM rows r JOIN typed USING (key, rid) JOIN mind i ON i.key = r.key AND i.date = r.date GROUP BY 1, 2 HAVING count(*) >= 3"""
NEEDS["perfr"] = ("typed", "mind")
_T = "abs(c * sqrt((n - 2) / greatest(1 - c * c, 1e-300)))"


@query("j04_indicator_by_regime", ctes("perfr") + f"SELECT typ AS regime_type, indicator, {r('c')} AS correlation, n::BIGINT AS n FROM perfr")
def _(spark, sf):
    return tidy(rg.indicator_by_regime(typed(spark, sf), mind(spark, sf)), regime_type="string", indicator="string", correlation=6, n="bigint")


# Above 200 rows the critical value is within 0.013 of 1.96; no correlation here lies that close to it.
@query("j04_regime_weights", ctes("perfr", w=f"SELECT *, CASE WHEN {_T} > {critical_t(0.05, 2000)} THEN abs(c) ELSE 0.1 END AS w FROM perfr") + f"SELECT typ AS regime_type, indicator, {r('w / sum(w) OVER (PARTITION BY typ)')} AS weight FROM w")
def _(spark, sf):
    return tidy(rg.regime_weights(rg.indicator_by_regime(typed(spark, sf), mind(spark, sf))), regime_type="string", indicator="string", weight=6)


SQL["wbase"] = "SELECT indicator, abs(corr(value, x)) / sum(abs(corr(value, x))) OVER () AS weight FROM series t JOIN mind i ON i.key = t.key AND i.date = t.date GROUP BY 1"
NEEDS["wbase"] = ("series", "mind")
_MAIN = "SELECT indicator, arg_max(c, n) AS c FROM perfr GROUP BY 1"


def wbase(spark, sf):
    from pyspark.sql import Window as W
    j = monthly(spark, sf).join(mind(spark, sf).withColumnRenamed("value", "x"), ["key", "date"])
    c = j.groupBy("indicator").agg(F.abs(F.corr("value", "x")).alias("c"))
    return c.select("indicator", (F.col("c") / F.sum("c").over(W.partitionBy())).alias("weight"))


@query("j05_adaptive_weights", ctes("wbase", "perfr", m=_MAIN, w="SELECT b.indicator, weight, weight * (0.5 + 0.5 * abs(c)) * (0.3 + 0.7 * weight) AS w FROM wbase b JOIN m USING (indicator)") + f"SELECT indicator, {r('weight')} AS weight, {r('w / sum(w) OVER ()')} AS adaptive_weight FROM w")
def _(spark, sf):
    base = cut_lineage(wbase(spark, sf))
    perf = rg.indicator_by_regime(typed(spark, sf), mind(spark, sf)).groupBy("indicator").agg(F.max_by("correlation", "n").alias("correlation"))
    return tidy(rg.adaptive_weights(base, perf, base.select("indicator", F.col("weight").alias("strength"))), indicator="string", weight=6, adaptive_weight=6)


@query("j06_learn_weights", ctes("wbase", "scored", e="SELECT least(1, avg(abs(actual - forecast) / actual)) AS e FROM scored WHERE model = 'flat'", c="SELECT indicator, weight, CASE WHEN e > 0.2 THEN -weight * e ELSE weight * (1 - e) END AS k FROM wbase, e",
                                 n="SELECT *, least(greatest(weight + 0.1 * k, 0.01), 1) AS w FROM c") + f"SELECT indicator, {r('weight')} AS weight, {r('k')} AS contribution, {r('w / sum(w) OVER ()')} AS new_weight FROM n")
def _(spark, sf):
    from panelloom.operators.accuracy import error_tables
    from panelloom.plans.base import scored
    whole, _each = error_tables(scored(spark, sf).where("model = 'flat'"), "id")
    return tidy(rg.learn_weights(wbase(spark, sf), whole), indicator="string", weight=6, contribution=6, new_weight=6)


_MAP = lambda t, d: "CASE typ " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {d} END"
SQL["par"] = f"SELECT key, rid, typ, least(greatest((coalesce(mv, 0.05) + coalesce(gv, 0.05)) / 2, 0.02), 0.2) AS bu, {_MAP(rg.TYPE_CONFIDENCE, 0.95)} AS bc, {_MAP(rg.TYPE_UNCERTAINTY, 0.1)} AS ru FROM typed"
NEEDS["par"] = ("typed",)


@query("j07_regime_parameters", ctes("par") + f"SELECT key, rid::BIGINT AS regime_id, typ AS regime_type, {r('bu')} AS base_uncertainty, {r('bc')} AS base_confidence, {r('ru')} AS regime_uncertainty FROM par")
def _(spark, sf):
    return tidy(rg.regime_parameters(rg.regime_table(cut_lineage(rows(spark, sf)))), key="bigint", regime_id="bigint", regime_type="string", base_uncertainty=6, base_confidence=6, regime_uncertainty=6)


@query("j07_weight_uncertainty", ctes("par", "wbase") + f"SELECT key, rid::BIGINT AS regime_id, indicator, {r('greatest(0.01, bu * (1.5 - weight))')} AS weight_uncertainty, {r('0.02 + 0.08 * (1 - weight)')} AS data_std, {r('weight * 0.1')} AS parameter_std FROM par, wbase")
def _(spark, sf):
    par = rg.regime_parameters(rg.regime_table(cut_lineage(rows(spark, sf))))
    return tidy(rg.weight_uncertainty(cut_lineage(wbase(spark, sf)), par), key="bigint", regime_id="bigint", indicator="string", weight_uncertainty=6, data_std=6, parameter_std=6)


SQL["feat"] = f"""SELECT * FROM (SELECT key, date, value, g, CASE WHEN count(g) OVER f = {WIN} THEN stddev_samp(g) OVER f END AS vol, CASE WHEN count(g) OVER f = {WIN} THEN avg(g) OVER f END AS mr, value / lag(value, {WIN}) OVER (PARTITION BY key ORDER BY date) - 1 AS mom
  FROM (SELECT *, value / lag(value) OVER (PARTITION BY key ORDER BY date) - 1 AS g FROM series) WINDOW f AS (PARTITION BY key ORDER BY date ROWS {WIN - 1} PRECEDING)) WHERE g IS NOT NULL AND vol IS NOT NULL AND mom IS NOT NULL"""
NEEDS["feat"] = ("series",)
SQL["thr"] = "SELECT f.*, (vol > a)::INT + (vol > b)::INT AS regime FROM feat f JOIN (SELECT key, quantile_cont(vol, 0.33) AS a, quantile_cont(vol, 0.67) AS b FROM feat GROUP BY 1) USING (key)"
NEEDS["thr"] = ("feat",)


def thr(spark, sf):
    return rg.threshold_regimes(rg.regime_features(monthly(spark, sf), WIN))


@query("j08_threshold_regimes", ctes("thr") + f"SELECT key, date, {r('vol')} AS volatility, {r('mr')} AS mean_return, {r('mom')} AS momentum, regime::INTEGER AS regime FROM thr")
def _(spark, sf):
    return tidy(thr(spark, sf), **KD, volatility=6, mean_return=6, momentum=6, regime="int")


@query("j08_volatility_regimes", ctes("feat", q="SELECT key, quantile_cont(vol, 0.25) AS a, quantile_cont(vol, 0.75) AS b FROM feat GROUP BY 1") + "SELECT key, date, CASE WHEN vol <= a THEN 1 WHEN vol <= b AND g >= 0 THEN 2 ELSE 0 END::INTEGER AS regime FROM feat JOIN q USING (key)")
def _(spark, sf):
    return tidy(rg.volatility_regimes(rg.regime_features(monthly(spark, sf), WIN)), **KD, regime="int")


@query("j09_mixture_regimes")
def _(spark, sf):
    return rg.mixture_regimes(cut_lineage(rg.regime_features(monthly(spark, sf), WIN))).groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("volatility").alias("volatility"))


SQL["trans"] = "SELECT a, b, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a) AS p FROM (SELECT regime AS a, lead(regime) OVER (PARTITION BY key ORDER BY date) AS b FROM thr) WHERE b IS NOT NULL GROUP BY 1, 2"
NEEDS["trans"] = ("thr",)


@query("j10_transitions", ctes("trans") + f"SELECT a::INTEGER AS from_regime, b::INTEGER AS to_regime, n::BIGINT AS n, {r('p')} AS probability FROM trans")
def _(spark, sf):
    return tidy(rg.transitions(thr(spark, sf)), from_regime="int", to_regime="int", n="bigint", probability=6)


@query("j10_stationary", ctes("trans", q="SELECT max(p) FILTER (WHERE a = 0 AND b = 1) AS p01, max(p) FILTER (WHERE a = 0 AND b = 2) AS p02, max(p) FILTER (WHERE a = 1 AND b = 0) AS p10, max(p) FILTER (WHERE a = 1 AND b = 2) AS p12, max(p) FILTER (WHERE a = 2 AND b = 0) AS p20, max(p) FILTER (WHERE a = 2 AND b = 1) AS p21 FROM trans",
                              z="SELECT coalesce(p01,0) AS p01, coalesce(p02,0) AS p02, coalesce(p10,0) AS p10, coalesce(p12,0) AS p12, coalesce(p20,0) AS p20, coalesce(p21,0) AS p21 FROM q",
                              s="SELECT p10 * p20 + p10 * p21 + p20 * p12 AS a, p01 * p20 + p01 * p21 + p21 * p02 AS b, p02 * p10 + p02 * p12 + p12 * p01 AS c FROM z") +
       f"SELECT 0 AS regime, {r('a / (a + b + c)')} AS share FROM s UNION ALL SELECT 1, {r('b / (a + b + c)')} FROM s UNION ALL SELECT 2, {r('c / (a + b + c)')} FROM s")
def _(spark, sf):
    return tidy(rg.stationary(rg.transitions(thr(spark, sf))), regime="int", share=6)


@query("j11_spells", ctes("thr", a="SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) - row_number() OVER (PARTITION BY key, regime ORDER BY date) AS isl FROM thr", s="SELECT key, regime, isl, count(*) AS len, sum(value) AS v FROM a GROUP BY 1, 2, 3") +
       f"SELECT regime::INTEGER AS regime, count(*)::BIGINT AS spells, {r('avg(len)')} AS mean_length, max(len)::BIGINT AS longest, {r('sum(v) / sum(len)', 3)} AS mean_value, {r('sum(len) / sum(sum(len)) OVER ()')} AS frequency FROM s GROUP BY 1")
def _(spark, sf):
    return tidy(rg.spells(thr(spark, sf)), regime="int", spells="bigint", mean_length=6, longest="bigint", mean_value=3, frequency=6)


@query("j12_market_conditions", ctes("cond") + f"SELECT key, date, {r('vol')} AS volatility, {r('tp')} AS volatility_percentile, {r('slope', 4)} AS trend_slope, {r('strength')} AS trend_strength, {r('mom')} AS momentum, regime, phase, {r('1 / (1 + vol)')} AS stability, {r('pred')} AS predictability FROM cond")
def _(spark, sf):
    return tidy(rg.market_conditions(monthly(spark, sf)), **KD, volatility=6, volatility_percentile=6, trend_slope=4, trend_strength=6, momentum=6, regime="string", phase="string", stability=6, predictability=6)


SQL["vprof"] = """SELECT key, avg(v) AS m, stddev_pop(v) AS s, arg_max(v, date) AS c, (count(*) FILTER (WHERE v < l) + count(*) FILTER (WHERE v <= l))::DOUBLE / (2 * count(*)) AS p FROM (SELECT key, date, v, last_value(v) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM (
  SELECT key, date, CASE WHEN count(ret) OVER w = 12 THEN stddev_pop(ret) OVER w END AS v FROM retn WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE v IS NOT NULL) GROUP BY 1"""
NEEDS["vprof"] = ("retn",)


@query("j13_volatility_profile", ctes("vprof") + f"SELECT key, {r('m')} AS mean_volatility, {r('s')} AS volatility_std, {r('c')} AS current_volatility, {r('p')} AS volatility_percentile FROM vprof")
def _(spark, sf):
    return tidy(rg.volatility_profile(monthly(spark, sf)), key="bigint", mean_volatility=6, volatility_std=6, current_volatility=6, volatility_percentile=6)


@query("j13_weight_tilt", ctes("invw", "vprof", t="SELECT w.key, model, c, weight * CASE WHEN c < 0.3 THEN CASE WHEN model IN ('linear', 'exponential') THEN 1.1 ELSE 1 END WHEN c > 0.5 THEN CASE WHEN model = 'naive' THEN 1.15 ELSE 0.95 END ELSE 1 END AS x FROM invw w JOIN vprof USING (key)") +
       f"SELECT key, model, CASE WHEN c < 0.3 THEN 'low' WHEN c > 0.5 THEN 'high' ELSE 'medium' END AS state, {r('x / sum(x) OVER (PARTITION BY key)')} AS tilted FROM t")
def _(spark, sf):
    from panelloom.operators import ensemble as en
    series = months(spark, sf)
    w = en.weights(dealt(cut_lineage(ql.perf(series)), "key"))
    return tidy(rg.tilt_weights(w, rg.volatility_profile(series), 0.3, 0.5), key="bigint", model="string", state="string", tilted=6)


@query("j13_recommendations", ctes("cond") + f"""SELECT key, CASE WHEN vol > 0.1 THEN 'volatility_aware' ELSE 'weighted' END AS ensemble_type, CASE WHEN pred < 0.3 THEN 'diversified' WHEN vol > 0.08 THEN 'adaptive' ELSE 'performance' END AS optimization_method,
  least(24, greatest(6, trunc(12 / vol)))::INTEGER AS volatility_window, {r('least(greatest(vol * 2, 0.05), 0.3)')} AS learning_rate FROM cond""")
def _(spark, sf):
    return tidy(rg.recommendations(rg.market_conditions(monthly(spark, sf))), key="bigint", ensemble_type="string", optimization_method="string", volatility_window="int", learning_rate=6)


@query("j14_current_regime", ctes("retn", c="SELECT key, count(ret) AS k, stddev_samp(ret) FILTER (WHERE t >= n - 12) AS a, stddev_samp(ret) AS b FROM retn GROUP BY 1") + f"SELECT key, {r('a')} AS recent, {r('b')} AS overall, CASE WHEN a > b * 1.5 THEN 0 ELSE 1 END::INTEGER AS regime, 0.7::DOUBLE AS confidence FROM c")
def _(spark, sf):
    return tidy(rg.current_regime(monthly(spark, sf)), key="bigint", recent=6, overall=6, regime="int", confidence="double")


@query("j15_learning_record", ctes("scored", m="SELECT market, id, year, avg(abs(actual - forecast) / actual) * 100 AS e FROM scored GROUP BY 1, 2, 3", l="SELECT *, row_number() OVER (PARTITION BY market, id ORDER BY year) AS i FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY market, id ORDER BY year DESC) <= 5)",
                                     f="SELECT market, id, avg(e) AS m, regr_slope(e, i) AS s, corr(e, i) AS c, count(*) AS n FROM l GROUP BY 1, 2") +
       f"SELECT market, id, {r('m')} AS recent_mean, {r('s')} AS slope, CASE WHEN abs(c * sqrt(3 / (1 - c * c))) <= {critical_t(0.05, 3)} THEN 'no_trend' WHEN s < -0.5 THEN 'improving' WHEN s > 0.5 THEN 'deteriorating' ELSE 'stable' END AS trend FROM f")
def _(spark, sf):
    from panelloom.plans.base import scored
    e = scored(spark, sf).groupBy("market", "id", "year").agg((F.avg(F.abs(F.col("actual") - F.col("forecast")) / F.col("actual")) * 100).alias("e"))
    return tidy(rg.error_trend(e, ["market", "id"], "year", "e"), market="string", id="bigint", recent_mean=6, slope=6, trend="string")


@query("j16_regime_analysis")
def _(spark, sf):
    base = cut_lineage(wbase(spark, sf))
    parts = rg.regime_analysis(monthly(spark, sf), mind(spark, sf), base, base.select("indicator", F.col("weight").alias("strength")), WIN)
    return parts["parameters"].groupBy("regime_type").agg(F.count(F.lit(1)).alias("regimes"), F.avg("base_uncertainty").alias("base_uncertainty")).join(
        parts["regime_weights"].groupBy("regime_type").agg(F.max_by("indicator", "weight").alias("main_indicator")), "regime_type", "left")
