"""Uncertainty over result tables."""

import uuid

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage, run_folder, with_row
from panelloom.operators import ensemble as en, indicators as ind, shares as sh, sketches as sk, uncertainty as un
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import DRAWS, NEEDS, SQL, ctes, facts, history, indicators, monthly, query, r, scenarios, sql_uniform, tidy
from panelloom.plans import q_l_ensemble as ql
from panelloom.plans.q_k_forecast import H
from panelloom.functions import scalars as S

MY = dict(market="string", year="int")
SQL["tot"] = "SELECT market, year, scenario_id, sum(value) AS total FROM scenarios GROUP BY 1, 2, 3"
NEEDS["tot"] = ("scenarios",)


def tot(spark, sf):
    return un.totals(scenarios(spark, sf))


@query("n01_scenario_bands", ctes("scenarios") + "SELECT market, id, year, " + ", ".join(f"{r(f'quantile_cont(value, {p / 100})', 4)} AS p{p}" for p in (5, 25, 50, 75, 95)) + f", {r('avg(value)', 4)} AS mean, {r('stddev_pop(value)', 4)} AS std FROM scenarios GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(un.bands(scenarios(spark, sf)), market="string", id="bigint", year="int", p5=4, p25=4, p50=4, p75=4, p95=4, mean=4, std=4)


@query("n01_stored_sketches", ctes("scenarios") + "SELECT market, id, year, count(*)::BIGINT AS n, " + ", ".join(f"{r(f'quantile_disc(value, {p / 100})', 4)} AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM scenarios GROUP BY 1, 2, 3")
def _(spark, sf):
    """The draws come in two lots; each lot's sketches are stored, then merged."""
    keys, draws = ["market", "id", "year"], scenarios(spark, sf)
    path = f"{run_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for lot in (0, 1):
        sk.store(draws.where(F.col("scenario_id") % 2 == lot), keys, path, lot)
    return tidy(sk.bands(sk.stored(spark, path, keys), keys), market="string", id="bigint", year="int", n="bigint", p5=4, p25=4, p50=4, p75=4, p95=4)


@query("n01_sketch_rank_error", ctes("scenarios") + "SELECT market, year, count(*)::BIGINT AS n, true AS within FROM scenarios GROUP BY 1, 2")
def _(spark, sf):
    """Sketches of single entities rolled up to markets, with the rank error over all draws: within 2 % at size 400."""
    draws = scenarios(spark, sf)
    fine = sk.sketches(draws, ["market", "id", "year"], size=400)
    out = sk.rank_errors(cut_lineage(sk.merged(fine, ["market", "year"], 400)), draws, ["market", "year"])
    return tidy(out.withColumn("within", F.col("rank_error") <= 0.02), market="string", year="int", n="bigint", within="boolean")


@query("n02_scenario_statistics", ctes("tot", m="SELECT *, avg(total) OVER (PARTITION BY market, year) AS m FROM tot") + f"""SELECT market, year, count(*)::BIGINT AS scenarios, 1.0::DOUBLE AS success_rate, {r('avg(total)', 3)} AS mean, {r('stddev_pop(total)', 3)} AS std, {r('min(total)', 3)} AS low, {r('max(total)', 3)} AS high,
  {r('avg((total - m) ** 3) / stddev_pop(total) ** 3', 5)} AS skewness, {r('avg((total - m) ** 4) / var_pop(total) ** 2 - 3', 5)} AS kurtosis FROM m GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(un.statistics(tot(spark, sf)), **MY, scenarios="bigint", success_rate=6, mean=3, std=3, low=3, high=3, skewness=5, kurtosis=5)


@query("n03_risk", ctes("tot", q="SELECT market, year, quantile_cont(total, 0.05) AS a, quantile_cont(total, 0.01) AS b, avg(total) AS m FROM tot GROUP BY 1, 2") + f"""SELECT market, year, {r('max(a)', 3)} AS var_95, {r('max(b)', 3)} AS var_99, {r('avg(total) FILTER (WHERE total <= a)', 3)} AS cvar_95,
  {r('stddev_pop(total) FILTER (WHERE total < m)', 3)} AS downside_deviation, {r('avg((total < m)::INT)')} AS prob_below_mean FROM tot JOIN q USING (market, year) GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(un.risk(tot(spark, sf)), **MY, var_95=3, var_99=3, cvar_95=3, downside_deviation=3, prob_below_mean=6)


@query("n03_drawdown", ctes("tot", c="SELECT *, total - avg(total) OVER (PARTITION BY market, scenario_id) AS d FROM tot", s="SELECT *, sum(d) OVER (PARTITION BY market, scenario_id ORDER BY year) AS c FROM c",
                            p="SELECT *, c - max(c) OVER (PARTITION BY market, scenario_id ORDER BY year) AS dd FROM s") + f"SELECT market, scenario_id, {r('min(dd)', 3)} AS max_drawdown FROM p GROUP BY 1, 2")
def _(spark, sf):
    return tidy(un.drawdown(tot(spark, sf)), market="string", scenario_id="bigint", max_drawdown=3)


_W = min(50, DRAWS // 2)


@query("n04_convergence", ctes("tot") + f"""SELECT market, year, count(*)::BIGINT AS n, {r(f'avg(total) FILTER (WHERE scenario_id > {DRAWS - _W})', 3)} AS recent_mean, {r('avg(total)', 3)} AS overall_mean, {r('stddev_pop(total) / sqrt(count(*))', 3)} AS std_error,
  {r(f'abs(avg(total) FILTER (WHERE scenario_id > {DRAWS - _W}) - avg(total))', 2)} AS mean_difference,
  {r(f'abs(avg(total) FILTER (WHERE scenario_id > {DRAWS - _W}) - avg(total) FILTER (WHERE scenario_id <= {DRAWS - _W})) / avg(total) FILTER (WHERE scenario_id <= {DRAWS - _W})')} AS block_change FROM tot GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(un.convergence(tot(spark, sf)), **MY, n="bigint", recent_mean=3, overall_mean=3, std_error=3, mean_difference=2, block_change=6)


@query("n05_scenario_concentration", ctes("scenarios") + f"SELECT market, year, scenario_id, {r('sum(value * value) / (sum(value) * sum(value)) * 10000')} AS hhi FROM scenarios GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(un.scenario_concentration(scenarios(spark, sf)), **MY, scenario_id="bigint", hhi=6)


_U = sql_uniform("market", "id", "s")


@query("n06_what_if", ctes("now", "world", x=f"SELECT s.market, s.id, s.year, CAST(s AS BIGINT) AS scenario_id, greatest(market_share * (1 + ({_U} - 0.5) * 0.4), 0.001) AS v, w.value * (1 + 0.01 * s) AS total FROM now s JOIN world w ON w.market = s.market AND w.year = s.year, range(1, 11) g(s)".replace("'s'", "'s'").replace("CAST(s AS VARCHAR)", "CAST(g.s AS VARCHAR)").replace("CAST(s AS BIGINT)", "CAST(g.s AS BIGINT)").replace("0.01 * s)", "0.01 * g.s)").replace("CAST(market AS", "CAST(s.market AS").replace("CAST(id AS", "CAST(s.id AS")) +
       f"SELECT market, id, year, scenario_id, {r('v / sum(v) OVER (PARTITION BY market, scenario_id) * 100')} AS market_share, {r('v / sum(v) OVER (PARTITION BY market, scenario_id) * total', 3)} AS value FROM x")
def _(spark, sf):
    s = cut_lineage(latest_slice(sh.market_shares(history(spark, sf))))
    world = s.groupBy("market").agg(F.sum("value").alias("w"))
    shocks = s.select("market", "id").join(world, "market").withColumn("scenario_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))))
    shocks = shocks.select("market", "id", "scenario_id", ((S.key_uniform("market", "id", "scenario_id") - 0.5) * 0.4).alias("shock"), (F.col("w") * (1 + 0.01 * F.col("scenario_id"))).alias("total"))
    return tidy(un.what_if(s.select("market", "id", "year", "market_share"), shocks), market="string", id="bigint", year="int", scenario_id="bigint", market_share=6, value=3)


# Outputs of value = lines x quantity x (1 - 5 discount) on the facts of one year (A) and of the next (B).
_OUT = lambda l, q, d: f"{l}.lines * {q}.quantity * (1 - 5 * {d}.discount) / 1000"
SQL["smp"] = "SELECT (a.id * 10000 + a.year)::BIGINT AS sample_id, x.p AS parameter, " + _OUT("a", "a", "a") + " AS a, " + _OUT("b", "b", "b") + " AS b, CASE p WHEN 'lines' THEN " + _OUT("a", "b", "b") + " WHEN 'quantity' THEN " + _OUT("b", "a", "b") + \
    " ELSE " + _OUT("b", "b", "a") + " END AS c, CASE p WHEN 'lines' THEN " + _OUT("a", "b", "b") + " WHEN 'quantity' THEN " + _OUT("b", "a", "b") + " ELSE " + _OUT("b", "b", "a") + \
    " END AS d FROM facts a JOIN facts b ON b.id = a.id AND b.year = a.year + 1, (VALUES ('lines'), ('quantity'), ('discount')) x(p)"
NEEDS["smp"] = ("facts",)
SQL["sob"] = """SELECT parameter, greatest(0, (avg(a * c) - avg(a) * avg(c)) / v) AS f, least(greatest(1 - (avg(b * d) - avg(b) * avg(d)) / v, 0), 1) AS t FROM (SELECT *, (avg(a * a) OVER w + avg(b * b) OVER w) / 2 - ((avg(a) OVER w + avg(b) OVER w) / 2) ** 2 AS v FROM smp WINDOW w AS (PARTITION BY parameter)) GROUP BY parameter, v"""
NEEDS["sob"] = ("smp",)


def samples(spark, sf):
    f = facts(spark, sf).select("id", "year", "lines", "quantity", "discount")
    b = f.select("id", (F.col("year") - 1).alias("year"), *[F.col(c).alias(f"b_{c}") for c in ("lines", "quantity", "discount")])
    j = f.join(b, ["id", "year"])
    out = lambda l, q, d: F.col(l) * F.col(q) * (1 - 5 * F.col(d)) / 1000
    cells = {"lines": out("lines", "b_quantity", "b_discount"), "quantity": out("b_lines", "quantity", "b_discount"), "discount": out("b_lines", "b_quantity", "discount")}
    rows = F.array(*[F.struct(F.lit(p).alias("parameter"), c.alias("c"), c.alias("d")) for p, c in cells.items()])
    return j.select((F.col("id") * 10000 + F.col("year")).alias("sample_id"), out("lines", "quantity", "discount").alias("a"), out("b_lines", "b_quantity", "b_discount").alias("b"), F.inline(rows))


@query("n07_sensitivity", ctes("sob") + f"""SELECT parameter, {r('f', 5)} AS first_order, {r('t', 5)} AS total_order, {r('greatest(0, t - f)', 5)} AS interaction, row_number() OVER (ORDER BY t DESC, parameter)::INTEGER AS total_rank, row_number() OVER (ORDER BY f DESC, parameter)::INTEGER AS first_rank,
  CASE WHEN t > 0.1 THEN 'high' WHEN t > 0.05 THEN 'medium' WHEN t > 0.01 THEN 'low' ELSE 'negligible' END AS importance FROM sob""")
def _(spark, sf):
    return tidy(un.sensitivity(samples(spark, sf)), parameter="string", first_order=5, total_order=5, interaction=5, total_rank="int", first_rank="int", importance="string")


@query("n07_interactions", ctes("sob", i="SELECT parameter, greatest(0, t - f) AS i FROM sob") + f"""SELECT a.parameter AS first, b.parameter AS second, {r('least(a.i, b.i)', 5)} AS interaction FROM i a JOIN i b ON a.parameter < b.parameter
  UNION ALL SELECT 'main_effects', 'interaction_effects', {r('greatest(0, 1 - sum(f))', 5)} FROM sob""")
def _(spark, sf):
    x = cut_lineage(un.sensitivity(samples(spark, sf)))
    v = un.variance_explained(x).select(F.lit("main_effects").alias("first"), F.lit("interaction_effects").alias("second"), F.col("interaction_effects").alias("interaction"))
    return tidy(un.pair_interaction(x).unionByName(v), first="string", second="string", interaction=5)


_P = " + ".join(f"(u >= {p})::INT" for p in ind.POISSON)


@query("n16_sensitivity_intervals", ctes("smp", w=f"SELECT *, ({_P})::DOUBLE AS w FROM (SELECT *, {sql_uniform('sample_id', 'rep')} AS u FROM smp, range(1, 21) g(rep))",
                                         m="SELECT parameter, rep, sum(w) AS n, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b, sum(w * c) / sum(w) AS c, sum(w * d) / sum(w) AS d, sum(w * a * a) / sum(w) AS aa, sum(w * b * b) / sum(w) AS bb, sum(w * a * c) / sum(w) AS ac, sum(w * b * d) / sum(w) AS bd FROM w GROUP BY 1, 2",
                                         x="SELECT parameter, greatest(0, (ac - a * c) / v) AS f, least(greatest(1 - (bd - b * d) / v, 0), 1) AS t FROM (SELECT *, (aa + bb) / 2 - ((a + b) / 2) ** 2 AS v FROM m)") +
       f"SELECT parameter, {r('quantile_cont(f, 0.025)', 5)} AS first_order_lower, {r('quantile_cont(f, 0.975)', 5)} AS first_order_upper, {r('quantile_cont(t, 0.025)', 5)} AS total_order_lower, {r('quantile_cont(t, 0.975)', 5)} AS total_order_upper FROM x GROUP BY 1")
def _(spark, sf):
    return tidy(un.sensitivity_intervals(samples(spark, sf), 20), parameter="string", first_order_lower=5, first_order_upper=5, total_order_lower=5, total_order_upper=5)


SQL["uni"] = """SELECT indicator, value, market_value, (rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0) / (count(*) OVER (PARTITION BY indicator) + 1) AS u,
  (rank() OVER (PARTITION BY indicator ORDER BY market_value) + (count(*) OVER (PARTITION BY indicator, market_value) - 1) / 2.0) / (count(*) OVER (PARTITION BY indicator) + 1) AS v FROM indicators"""
NEEDS["uni"] = ("indicators",)


@query("n08_dependence", ctes("uni") + f"""SELECT indicator, {r('corr(value, market_value)')} AS pearson, {r('corr(u, v)')} AS spearman, {r('count(*) FILTER (WHERE u > 0.95 AND v > 0.95)::DOUBLE / count(*) FILTER (WHERE u > 0.95)')} AS upper_tail,
  {r('count(*) FILTER (WHERE u < 0.05 AND v < 0.05)::DOUBLE / nullif(count(*) FILTER (WHERE u < 0.05), 0)')} AS lower_tail FROM uni GROUP BY 1""")
def _(spark, sf):
    return tidy(un.dependence(cut_lineage(indicators(spark, sf)), ["indicator"], "value", "market_value"), indicator="string", pearson=6, spearman=6, upper_tail=6, lower_tail=6)


@query("n08_copula_parameters", ctes("indicators", p="SELECT a.indicator, sum(sign(a.value - b.value) * sign(a.market_value - b.market_value)) AS s, sum((a.value = b.value)::INT) AS tx, sum((a.market_value = b.market_value)::INT) AS ty, count(*) AS n FROM indicators a JOIN indicators b ON a.indicator = b.indicator AND (a.id, a.year) < (b.id, b.year) GROUP BY 1",
                                     t="SELECT indicator, s / sqrt((n - tx)::DOUBLE * (n - ty)) AS t FROM p") + f"SELECT indicator, {r('t')} AS kendall, {r('CASE WHEN t > 0 THEN greatest(2 * t / (1 - t), 1e-6) ELSE 1e-6 END')} AS clayton, {r('CASE WHEN t > 0 THEN greatest(1 / (1 - t), 1.001) ELSE 1.001 END')} AS gumbel, {r('4 * t / (1 - t)')} AS frank FROM t")
def _(spark, sf):
    return tidy(un.dependence(cut_lineage(indicators(spark, sf)), ["indicator"], "value", "market_value"), indicator="string", kendall=6, clayton=6, gumbel=6, frank=6)


@query("n09_variance_split", ctes("fcs", m="SELECT key, model, count(*) AS n, avg(value / 1000) AS m, var_pop(value / 1000) AS v FROM fcs GROUP BY 1, 2", s="SELECT key, sum(n * v) / sum(n) AS w, sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 AS b FROM m GROUP BY 1") +
       f"SELECT key, {r('w', 2)} AS within, {r('b', 2)} AS between, {r('w + b', 2)} AS total, {r('b / (w + b)', 4)} AS between_ratio FROM s")
def _(spark, sf):
    f = ql.fcs(spark, sf).withColumn("value", F.col("value") / 1000)
    return tidy(un.variance_split(f, ["key"]), key="bigint", within=2, between=2, total=2, between_ratio=4)


@query("n10_entropy", ctes("indicators", e="SELECT indicator, value, min(value) OVER w AS a, max(value) OVER w AS b, count(*) OVER w AS n, least(50, floor(sqrt(count(*) OVER w))) AS k FROM indicators WINDOW w AS (PARTITION BY indicator)",
                           c="SELECT indicator, least(floor((value - a) / (b - a) * k), k - 1) AS bin, count(*)::DOUBLE / max(n) AS p, max((b - a) / k) AS w FROM e GROUP BY 1, 2") + f"SELECT indicator, {r('-sum(p * ln(p / w))')} AS entropy, count(*)::BIGINT AS filled_bins FROM c GROUP BY 1")
def _(spark, sf):
    return tidy(un.entropy(indicators(spark, sf), ["indicator"], "value"), indicator="string", entropy=6, filled_bins="bigint")


@query("n10_mutual_information", ctes("indicators", e="SELECT indicator, least(floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * floor(sqrt(count(*) OVER w))), floor(sqrt(count(*) OVER w)) - 1) AS x, least(floor((market_value - min(market_value) OVER w) / (max(market_value) OVER w - min(market_value) OVER w) * floor(sqrt(count(*) OVER w))), floor(sqrt(count(*) OVER w)) - 1) AS y FROM indicators WINDOW w AS (PARTITION BY indicator)",
                                      c="SELECT indicator, x, y, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3", p="SELECT *, sum(c) OVER (PARTITION BY indicator) AS t, sum(c) OVER (PARTITION BY indicator, x) AS px, sum(c) OVER (PARTITION BY indicator, y) AS py FROM c") +
       f"SELECT indicator, {r('sum(c / t * ln(c * t / (px * py)))')} AS mutual_information FROM p GROUP BY 1")
def _(spark, sf):
    return tidy(un.mutual_information(indicators(spark, sf), ["indicator"], "value", "market_value"), indicator="string", mutual_information=6)


@query("n11_bootstrap_band", ql._BAG + f"SELECT key, date, CAST(horizon AS INTEGER) AS horizon, {r('avg(v)', 4)} AS value, {r('quantile_cont(v, 0.05)', 4)} AS lower, {r('quantile_cont(v, 0.95)', 4)} AS upper, {r('stddev_pop(v)', 4)} AS std FROM x GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(en.bagging(monthly(spark, sf), H, levels=(0.05, 0.95)), key="bigint", date="date", horizon="int", value=4, lower=4, upper=4, std=4)


SQL["spr"] = "SELECT key, date, horizon, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM fcs GROUP BY 1, 2, 3"
NEEDS["spr"] = ("fcs",)


@query("n12_model_spread", ctes("spr") + f"SELECT key, date, CAST(horizon AS INTEGER) AS horizon, {r('m', 4)} AS mean, {r('s', 4)} AS std, {r('hi - lo', 4)} AS range, {r('1 - s / m')} AS agreement FROM spr")
def _(spark, sf):
    return tidy(un.model_spread(ql.fcs(spark, sf)), key="bigint", date="date", horizon="int", mean=4, std=4, range=4, agreement=6)


_Z = "1.959963984540054::DOUBLE"


@query("n13_horizon_band", ctes("spr") + "\nUNION ALL ".join(f"SELECT key, date, '{m}' AS method, {r(f'm - {_Z} * s * {e} * (1 + 0.5 * horizon * 0.1)', 3)} AS lower, {r(f'm + {_Z} * s * {e} * (1 + 0.5 * horizon * 0.1)', 3)} AS upper FROM spr" for m, e in (("sqrt_time", "sqrt(horizon)"), ("linear", "horizon"), ("exponential", "exp(horizon * 0.1)"))))
def _(spark, sf):
    s = un.model_spread(ql.fcs(spark, sf)).withColumn("vol", F.lit(0.5))
    out = None
    for m in ("sqrt_time", "linear", "exponential"):
        d = un.horizon_band(s, "mean", "std", "vol", m).select("key", "date", F.lit(m).alias("method"), "lower", "upper")
        out = d if out is None else out.unionByName(d)
    return tidy(out, key="bigint", date="date", method="string", lower=3, upper=3)


@query("n14_combined_band", ctes("spr", x=f"SELECT key, date, horizon, m, (0.3 * (m - 1.96 * s) + 0.3 * (m - {_Z} * s * sqrt(horizon)) + 0.4 * (m * (0.9 - 0.01 * (horizon % 3)))) / 1.0 AS l, (0.3 * (m + 1.96 * s) + 0.3 * (m + {_Z} * s * sqrt(horizon)) + 0.4 * (m * 1.1)) / 1.0 AS u FROM spr",
                                 y="SELECT *, (u - l) / (2 * 1.96) AS s0 FROM x", f="SELECT key, horizon, s0 AS s FROM y WHERE horizon = 1 UNION ALL SELECT y.key, y.horizon, CASE WHEN y.s0 < f.s THEN f.s * 1.05 ELSE y.s0 END FROM f JOIN y ON y.key = f.key AND y.horizon = f.horizon + 1") +
       f"SELECT y.key, y.date, CAST(y.horizon AS INTEGER) AS horizon, {r('CASE WHEN s > s0 THEN m - 1.96 * s ELSE l END', 3)} AS lower, {r('CASE WHEN s > s0 THEN m + 1.96 * s ELSE u END', 3)} AS upper, {r('s', 3)} AS std FROM y JOIN f ON f.key = y.key AND f.horizon = y.horizon")
def _(spark, sf):
    s = cut_lineage(un.model_spread(ql.fcs(spark, sf)).withColumn("value", F.col("mean")))
    cols = ["key", "date", "horizon", "value", "lower", "upper"]
    model = s.withColumn("lower", F.col("mean") - 1.96 * F.col("std")).withColumn("upper", F.col("mean") + 1.96 * F.col("std")).select(*cols, F.lit("model").alias("method"))
    time = un.horizon_band(s, "mean", "std").select(*cols, F.lit("horizon").alias("method"))
    boot = s.withColumn("lower", F.col("mean") * (0.9 - 0.01 * (F.col("horizon") % 3))).withColumn("upper", F.col("mean") * 1.1).select(*cols, F.lit("bootstrap").alias("method"))
    return tidy(un.combine_bands(model.unionByName(time).unionByName(boot)), key="bigint", date="date", horizon="int", lower=3, upper=3, std=3)


@query("n15_control_variate", ctes("facts", e="SELECT avg(lines) AS e FROM facts", g="SELECT id, avg(market_value) AS m, avg(lines) AS c, covar_samp(market_value, lines) AS tc, var_pop(lines) AS vc, corr(market_value, lines) AS r FROM facts GROUP BY 1") +
       f"SELECT id, {r('m', 3)} AS plain, {r('m - tc / vc * (c - e)', 3)} AS estimate, {r('1 / (1 - r * r)', 3)} AS reduction FROM g, e")
def _(spark, sf):
    f = cut_lineage(facts(spark, sf))
    e = f.agg(F.avg("lines").alias("e"))
    return tidy(un.control_variate(f.transform(with_row, e), ["id"], "market_value", "lines", "e"), id="bigint", plain=3, estimate=3, reduction=3)


@query("n15_stratified", ctes("scenarios", p="SELECT market, year, scenario_id % 4 AS s, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM scenarios GROUP BY 1, 2, 3") + f"SELECT market, year, {r('sum(n * m) / sum(n)', 3)} AS mean, {r('sum(n * v) / sum(n) / sum(n) / 1e6', 3)} AS variance, count(*)::BIGINT AS strata FROM p GROUP BY 1, 2")
def _(spark, sf):
    out = un.stratified(scenarios(spark, sf).withColumn("s", F.col("scenario_id") % 4), ["market", "year"], "s", "value").withColumn("variance", F.col("variance") / 1e6)
    return tidy(out, **MY, mean=3, variance=3, strata="bigint")


@query("n17_posterior_summary", ctes("scenarios", p="SELECT market, id, var_pop(value) * 1.5 AS pv FROM history GROUP BY 1, 2", s="SELECT market, id, avg(value) AS m, var_pop(value) AS v, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(*) AS n FROM scenarios GROUP BY 1, 2") +
       f"SELECT market, id, {r('m', 3)} AS mean, {r('lo', 3)} AS lower, {r('hi', 3)} AS upper, {r('greatest(0, 1 - v / pv)')} AS reduction, {r('v * (1 + 1.0::DOUBLE / n) / 1e6', 3)} AS predictive_variance FROM s JOIN p USING (market, id)")
def _(spark, sf):
    prior = history(spark, sf).groupBy("market", "id").agg((F.var_pop("value") * 1.5).alias("prior_variance"))
    out = un.posterior_summary(scenarios(spark, sf), prior, ["market", "id"]).withColumn("predictive_variance", F.col("predictive_variance") / 1e6)
    return tidy(out, market="string", id="bigint", mean=3, lower=3, upper=3, reduction=6, predictive_variance=3)


SQL["chk"] = "SELECT market, year, scenario_id, abs(avg(total) OVER (PARTITION BY market, year ORDER BY scenario_id) / avg(total) OVER (PARTITION BY market, year) - 1) AS m FROM tot"
NEEDS["chk"] = ("tot",)


@query("n18_convergence_diagnosis", ctes("chk", t="SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY scenario_id DESC) AS r FROM chk", f="SELECT market, year, regr_slope(m, -r) AS s, var_pop(m) AS v, max(m) FILTER (WHERE r = 1) AS z FROM t WHERE r <= 5 GROUP BY 1, 2",
                                         g="SELECT *, CASE WHEN s < -0.001 THEN 'improving' WHEN s > 0.001 THEN 'deteriorating' ELSE 'stable' END AS trend, CASE WHEN v < 0.0001 THEN 'very_stable' WHEN v < 0.0005 THEN 'stable' ELSE 'unstable' END AS stability FROM f") +
       "SELECT market, year, trend, stability, CASE WHEN z < 0.001 AND stability <> 'unstable' THEN 'can_stop' WHEN trend = 'improving' THEN 'continue_brief' WHEN trend = 'deteriorating' THEN 'increase_samples' ELSE 'continue_monitoring' END AS recommendation FROM g")
def _(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("market", "year")
    t = tot(spark, sf).withColumn("m", F.abs(F.avg("total").over(w.orderBy("scenario_id").rowsBetween(W.unboundedPreceding, 0)) / F.avg("total").over(w) - 1))
    return tidy(un.diagnose(t, ["market", "year"], "scenario_id", "m", 0.001), **MY, trend="string", stability="string", recommendation="string")
