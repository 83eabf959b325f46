"""Accuracy and calibration."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage
from panelloom.operators import accuracy as ac, shares as sh
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import NEEDS, SQL, ctes, history, query, r, scored, tidy
from panelloom.roles import DEFAULT

MODEL = DEFAULT.with_(by=("market", "model"))
KEY = dict(market="string", model="string")
_E = "abs(actual - forecast)"
_R2 = "CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - forecast) ** 2) / (var_pop(actual) * count(*)) WHEN sum((actual - forecast) ** 2) = 0 THEN 1 ELSE 0 END"
SQL["bt"] = f"""SELECT market, model, period, id, avg({_E} / abs(actual)) * 100 AS mape, sqrt(avg((actual - forecast) ** 2)) AS rmse, {_R2} AS r2, avg((forecast - actual) / actual * 100) AS bias, count(*) AS n, avg(forecast) AS w
  FROM scored JOIN (SELECT market, model, max(year) AS ly FROM scored GROUP BY 1, 2) USING (market, model), (VALUES (1), (3), (5)) p(period) WHERE year > ly - period GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND sum(actual) > 0"""
NEEDS["bt"] = ("scored",)
SQL["psum"] = "SELECT market, model, period, sum(mape * w) / sum(w) AS mape, sum(rmse * w) / sum(w) AS rmse, sum(bias * w) / sum(w) AS bias, median(r2) AS r2, count(*) AS n FROM bt GROUP BY 1, 2, 3"
NEEDS["psum"] = ("bt",)
SQL["whole"] = "SELECT market, model, avg(mape) AS mape, avg(rmse) AS rmse, avg(bias) AS bias, avg(r2) AS r2 FROM psum GROUP BY 1, 2"
NEEDS["whole"] = ("psum",)
SQL["conf"] = """SELECT *, CASE WHEN c >= 0.85 THEN 'conservative' WHEN c >= 0.7 THEN 'moderate' WHEN c >= 0.5 THEN 'aggressive' ELSE 'very_aggressive' END AS approach,
  CASE WHEN c >= 0.85 THEN 0.05 WHEN c >= 0.7 THEN 0.1 WHEN c >= 0.5 THEN 0.2 ELSE 0.3 END AS f FROM (SELECT *,
  0.4 * least(greatest(1 - mape / 50, 0), 1) + 0.4 * least(greatest(r2, 0), 1) + 0.1 * least(greatest(1 - rmse / 1000, 0), 1) + 0.1 * least(greatest(1 - abs(bias) / 25, 0), 1) AS c FROM whole)"""
NEEDS["conf"] = ("whole",)


def entities(spark, sf):
    return ac.backtest(scored(spark, sf), roles=MODEL)


@query("m01_backtest_entities", ctes("bt") + f"SELECT market, model, period, id, {r('mape')} AS mape, {r('rmse', 4)} AS rmse, {r('r2')} AS r2, {r('bias')} AS bias, n::BIGINT AS n FROM bt")
def _(spark, sf):
    return tidy(entities(spark, sf), **KEY, period="int", id="bigint", mape=6, rmse=4, r2=6, bias=6, n="bigint")


@query("m01_backtest_summary", ctes("psum") + f"SELECT market, model, period, {r('mape')} AS mape, {r('rmse', 4)} AS rmse, {r('bias')} AS bias, {r('r2')} AS r2, n::BIGINT AS entities FROM psum")
def _(spark, sf):
    return tidy(ac.period_summary(entities(spark, sf), MODEL), **KEY, period="int", mape=6, rmse=4, bias=6, r2=6, entities="bigint")


@query("m02_series_metrics", ctes("scored") + f"SELECT market, model, id, {r(f'avg({_E})', 4)} AS mae, {r(f'avg({_E} / abs(actual)) * 100')} AS mape, {r('sqrt(avg((actual - forecast) ** 2))', 4)} AS rmse, "
       f"{r('sqrt(avg((actual - forecast) ** 2)) / sqrt(avg(actual ** 2) + avg(forecast ** 2))')} AS theil_u FROM scored GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(ac.series_metrics(scored(spark, sf), ["market", "model", "id"]), **KEY, id="bigint", mae=4, mape=6, rmse=4, theil_u=6)


SQL["ext"] = f"""SELECT model, avg({_E}) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse, avg({_E} / actual) * 100 AS mape, {_R2} AS r2, avg(CASE WHEN pa IS NOT NULL THEN ((actual > pa) = (forecast > pp))::INT END) * 100 AS dir,
  avg(forecast - actual) AS bias, avg(forecast - actual) / avg(actual) * 100 AS bp, sqrt(avg(CASE WHEN pa IS NOT NULL THEN (forecast - actual) ** 2 END) / avg((pa - actual) ** 2)) AS u
  FROM (SELECT *, lag(actual) OVER w AS pa, lag(forecast) OVER w AS pp FROM scored WINDOW w AS (PARTITION BY market, model, id ORDER BY year)) GROUP BY 1"""
NEEDS["ext"] = ("scored",)


@query("m03_extended_metrics", ctes("ext") + f"SELECT model, {r('mae', 4)} AS mae, {r('rmse', 4)} AS rmse, {r('mape')} AS mape, {r('r2')} AS r2, {r('dir')} AS direction, {r('bias', 4)} AS bias, {r('bp')} AS bias_pct, {r('u')} AS theil_u FROM ext")
def _(spark, sf):
    out = ac.extended_metrics(scored(spark, sf), ["model"], ["market", "model", "id"])
    return tidy(out, model="string", mae=4, rmse=4, mape=6, r2=6, direction=6, bias=4, bias_pct=6, theil_u=6)


@query("m04_horizon_table", ctes("scored") + f"SELECT model, horizon, {r(f'avg({_E})', 4)} AS mae, {r(f'avg({_E} / abs(actual)) * 100')} AS mape, {r('sqrt(avg((actual - forecast) ** 2))', 4)} AS rmse FROM scored GROUP BY 1, 2")
def _(spark, sf):
    return tidy(ac.horizon_table(scored(spark, sf)), model="string", horizon="int", mae=4, mape=6, rmse=4)


@query("m04_model_comparison", ctes("scored", m=f"SELECT model, avg({_E} / abs(actual)) * 100 AS mape FROM scored GROUP BY 1") + f"SELECT model, {r('mape')} AS mape, row_number() OVER (ORDER BY mape)::INTEGER AS rank FROM m")
def _(spark, sf):
    return tidy(ac.model_comparison(scored(spark, sf)), model="string", mape=6, rank="int")


@query("m05_residuals", ctes("scored") + f"SELECT market, model, id, year, {r('actual - forecast', 4)} AS residual, {r('(actual - forecast) / actual * 100')} AS residual_pct, {_E} <= forecast * 0.1 AS in_band FROM scored")
def _(spark, sf):
    return tidy(ac.residual_table(scored(spark, sf)), **KEY, id="bigint", year="int", residual=4, residual_pct=6, in_band="boolean")


@query("m05_coverage", ctes("scored") + f"SELECT market, model, h::DOUBLE AS half_width, {r(f'avg(({_E} <= forecast * h)::INT)')} AS coverage FROM scored, (VALUES (0.05), (0.1), (0.2), (0.4)) v(h) GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(ac.coverage(scored(spark, sf), ["market", "model"]), **KEY, half_width="double", coverage=6)


@query("m06_confidence", ctes("conf") + f"SELECT market, model, {r('c')} AS confidence, approach FROM conf")
def _(spark, sf):
    return tidy(ac.confidence_score(ac.overall(ac.period_summary(entities(spark, sf), MODEL), MODEL)), **KEY, confidence=6, approach="string")


@query("m07_entity_adjustments", ctes("bt", "conf", m="SELECT market, model, id, avg(mape) AS mape, avg(bias) AS bias FROM bt GROUP BY 1, 2, 3 HAVING avg(mape) > 30",
                                      k="SELECT *, row_number() OVER (PARTITION BY market, model ORDER BY mape DESC, id) AS rank FROM m") + f"""
  SELECT k.market, k.model, k.id, rank::INTEGER AS rank, {r('k.mape')} AS mape, {r('least(0.5, k.mape / 100) * f')} AS strength, {r('-k.bias / 100 * least(0.5, k.mape / 100) * f')} AS growth_adjustment FROM k JOIN conf USING (market, model) WHERE rank <= 10""")
def _(spark, sf):
    e = cut_lineage(entities(spark, sf))
    scores = ac.confidence_score(ac.overall(ac.period_summary(e, MODEL), MODEL))
    return tidy(ac.entity_adjustments(e, scores, roles=MODEL), **KEY, id="bigint", rank="int", mape=6, strength=6, growth_adjustment=6)


@query("m08_apply_calibration", ctes("shares", "bt", b="SELECT market, id, bias FROM bt WHERE model = 'plus10' AND period = 5",
                                     x="SELECT s.market, s.id, s.year, s.value * f AS value, s.market_share * f AS sh FROM (SELECT s.*, CASE WHEN abs(coalesce(bias, 0)) > 10 AND year >= 1998 THEN 1 - coalesce(bias, 0) / 100 * 0.5 ELSE 1 END AS f FROM shares s LEFT JOIN b USING (market, id)) s") + f"""
  SELECT market, id, year, {r('sh / sum(sh) OVER w * 100')} AS market_share, {r('sh / sum(sh) OVER w * sum(value) OVER w', 4)} AS value FROM x WINDOW w AS (PARTITION BY market, year)""")
def _(spark, sf):
    bias = entities(spark, sf).where("model = 'plus10' and period = 5").select("market", "id", "bias")
    return tidy(ac.apply_calibration(sh.market_shares(history(spark, sf)), bias, 1998), market="string", id="bigint", year="int", market_share=6, value=4)


def _tiers(spark, sf):
    return latest_slice(sh.market_shares(history(spark, sf))).select("market", "id", sh.tier_of("market_share", (2.0, 1.0, 0.5)).alias("tier"))


SQL["impact"] = """SELECT market, least(greatest(coalesce((max(m) - min(m)) / avg(m), 0), 0), 1) AS impact FROM (SELECT market, tier, avg(mape) AS m FROM bt JOIN
  (SELECT market, id, CASE WHEN market_share >= 2 THEN 1 WHEN market_share >= 1 THEN 2 WHEN market_share >= 0.5 THEN 3 ELSE 4 END AS tier FROM now) USING (market, id) GROUP BY 1, 2) GROUP BY 1"""
NEEDS["impact"] = ("bt", "now")
_COMP = ", ".join(f"('{c}', {w})" for c, w in ac.COMPONENT_WEIGHTS.items())
SQL["comp"] = f"SELECT market, component, weight, CASE WHEN component = 'tier_classification' THEN impact ELSE impact * weight END AS impact FROM impact, (VALUES {_COMP}) c(component, weight)"
NEEDS["comp"] = ("impact",)


def components(spark, sf):
    imp = ac.tier_impact(entities(spark, sf), _tiers(spark, sf))
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(w).alias("weight")) for c, w in ac.COMPONENT_WEIGHTS.items()])
    out = imp.select("market", "impact", F.inline(rows))
    return out.withColumn("impact", F.when(F.col("component") == "tier_classification", F.col("impact")).otherwise(F.col("impact") * F.col("weight")))


@query("m09_component_weights", ctes("comp", n="SELECT *, least(greatest(weight * (1 + (1 / (1 + exp(-10 * ((1 - impact) - 0.5))) - 0.5) * 2 * 0.15), 0.05), 0.5) AS nw FROM comp") + f"""
  SELECT market, component, {r('impact')} AS impact, {r('nw')} AS new_weight, {r('nw / sum(nw) OVER (PARTITION BY market)')} AS normalized FROM n""")
def _(spark, sf):
    return tidy(ac.update_weights(components(spark, sf)), market="string", component="string", impact=6, new_weight=6, normalized=6)


@query("m10_parameter_updates", ctes("comp", "conf", c="SELECT market, approach, f FROM conf WHERE model = 'flat'") + f"""
  SELECT market, component, approach, {r('weight * (1 + CASE WHEN impact > 0.1 THEN f * (CASE WHEN weight > 0.18 THEN 1 ELSE -1 END) ELSE 0 END)')} AS new_value FROM comp JOIN c USING (market)""")
def _(spark, sf):
    e = cut_lineage(entities(spark, sf))
    scores = ac.confidence_score(ac.overall(ac.period_summary(e, MODEL), MODEL)).where("model = 'flat'").select("market", "approach")
    p = components(spark, sf).join(scores, "market").withColumn("value", F.col("weight")).withColumn("direction", F.when(F.col("weight") > 0.18, 1.0).otherwise(-1.0))
    return tidy(ac.update_parameters(p, 0.1), market="string", component="string", approach="string", new_value=6)


@query("m12_error_tables", ctes("scored", f="SELECT * FROM scored WHERE model = 'flat'") + f"""
  SELECT -1::BIGINT AS id, {r(f'avg({_E} / abs(actual)) * 100')} AS mape, {r('sqrt(avg((actual - forecast) ** 2))', 4)} AS rmse, {r(f'avg({_E})', 4)} AS mae, {r('avg(forecast - actual)', 4)} AS bias, {r(_R2)} AS r2 FROM f
  UNION ALL SELECT id, {r(f'avg({_E} / abs(actual)) * 100')}, NULL, NULL, NULL, NULL FROM f GROUP BY 1""")
def _(spark, sf):
    whole, each = ac.error_tables(scored(spark, sf).where("model = 'flat'"), "id")
    out = whole.withColumn("id", F.lit(-1)).unionByName(each, allowMissingColumns=True)
    return tidy(out, id="bigint", mape=6, rmse=4, mae=4, bias=4, r2=6)


@query("m13_calibration_run")
def _(spark, sf):
    rep = ac.calibration_report(cut_lineage(scored(spark, sf).where("model = 'flat'")), _tiers(spark, sf))
    return (rep["scores"].join(rep["impact"], "market").join(rep["adjustments"].groupBy("market").agg(F.count(F.lit(1)).alias("adjusted"), F.avg("strength").alias("mean_strength")), "market", "left"))


@query("m14_verdicts", ctes("ext", v="""SELECT model, CASE WHEN mape < 10 THEN 'excellent' WHEN mape < 20 THEN 'good' WHEN mape < 30 THEN 'fair' ELSE 'poor' END AS mape,
  CASE WHEN r2 > 0.9 THEN 'strong' WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.5 THEN 'moderate' ELSE 'weak' END AS r2, CASE WHEN abs(bp) < 5 THEN 'minimal' WHEN bp > 5 THEN 'overestimates' WHEN bp < -5 THEN 'underestimates' ELSE 'borderline' END AS bias,
  CASE WHEN dir > 80 THEN 'excellent' WHEN dir > 70 THEN 'good' WHEN dir > 60 THEN 'fair' ELSE 'poor' END AS direction, CASE WHEN u < 1 THEN 'beats naive' WHEN u > 1 THEN 'worse than naive' ELSE 'equal' END AS theil_u FROM ext""") +
       "SELECT model, metric, verdict FROM (UNPIVOT v ON mape, r2, bias, direction, theil_u INTO NAME metric VALUE verdict)")
def _(spark, sf):
    return ac.verdicts(ac.extended_metrics(scored(spark, sf), ["model"], ["market", "model", "id"]))


@query("m11_calibration_history", ctes("bt") + f"SELECT k AS calibration_id, market, model, count(*)::BIGINT AS n, {r('avg(mape)')} AS mape FROM bt JOIN (VALUES (3, 3), (4, 5), (5, 3), (6, 5), (7, 3)) v(k, p) ON period = p GROUP BY 1, 2, 3")
def _(spark, sf):
    import uuid
    from panelloom.functions.session import run_folder
    from panelloom.sources.sinks import append_history, load_history
    path = f"{run_folder(spark)}/history-{uuid.uuid4().hex}"
    e = cut_lineage(entities(spark, sf))
    for run in range(1, 8):
        append_history(e.where(F.col("period") == (3 if run % 2 else 5)).select("market", "model", "id", "mape"), path, run)
    kept = load_history(spark, path, 5)
    return tidy(kept.groupBy("calibration_id", "market", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("mape").alias("mape")), calibration_id="int", market="string", model="string", n="bigint", mape=6)
