"""Share distribution."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage
from panelloom.operators import forecast as fc, regions as rg, shares as sh
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import SQL, NEEDS, ctes, edges, history, panel, parts, query, r, tidy, world
from panelloom.roles import DEFAULT, DistributionSettings

HORIZON = 3
THRESHOLDS = (2.0, 1.0, 0.5)
SET = DistributionSettings(tier_thresholds=THRESHOLDS)
TIER = "CASE WHEN {0} >= 2 THEN 1 WHEN {0} >= 1 THEN 2 WHEN {0} >= 0.5 THEN 3 ELSE 4 END"


def shares(spark, sf):
    return sh.market_shares(history(spark, sf))


# Chain of inputs in SQL form; each step is the twin of one operator.
SQL["changes"] = """SELECT *, CASE WHEN lag(market_share) OVER w > 1e-6 THEN market_share / lag(market_share) OVER w ELSE 1.0 END AS change,
  year AS y2 FROM shares WINDOW w AS (PARTITION BY market, id ORDER BY year)"""
NEEDS["changes"] = ("shares",)
SQL["phase"] = """SELECT market, id, m AS mean_change, s AS std_change, n, CASE WHEN n < 2 THEN 'growth' WHEN m > 2 AND s > 0.5 THEN 'emerging' WHEN m > 1.2 THEN 'growth'
  WHEN m > 0.8 AND s < 0.3 THEN 'mature' ELSE 'declining' END AS phase
  FROM (SELECT market, id, avg(change) AS m, stddev_pop(change) AS s, count(*) AS n FROM changes GROUP BY 1, 2)"""
NEEDS["phase"] = ("changes",)
SQL["bounds"] = "SELECT * FROM (VALUES ('emerging', 0.01, 50.0), ('growth', 0.05, 20.0), ('mature', 0.5, 5.0), ('declining', 0.1, 2.0)) b(phase, lo, hi)"
SQL["trend"] = """SELECT market, id, CASE WHEN max(n) < 2 OR sum(w) IS NULL THEN 1.0::DOUBLE ELSE least(greatest(1 + (sum(w * change) / sum(w) - 1) * 0.5, 0.8), 1.3)::DOUBLE END AS trend_factor FROM (
  SELECT market, id, n, change, CASE WHEN ok THEN 0.5 + 0.5 * (n - sum(ok::INT) OVER (PARTITION BY market, id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / nullif(n - 1, 0)::DOUBLE END AS w
  FROM (SELECT c.market, c.id, c.year, c.change, p.n, c.change > b.lo AND c.change < b.hi AS ok FROM changes c JOIN phase p USING (market, id) JOIN bounds b USING (phase))) GROUP BY 1, 2"""
NEEDS["trend"] = ("phase", "bounds")
SQL["raw_proj"] = f"""SELECT market, id, name, CAST(year + h AS INTEGER) AS year, tier,
    market_share * least(greatest(pow(trend_factor, greatest(2.0 / (1 + exp(0.3 * h)) - 0.5, 0) * h), 1 - cap), 1 + cap) AS s FROM (
  SELECT s.market, s.id, s.name, s.year, s.market_share, t.trend_factor, {TIER.format('s.market_share')} AS tier, h,
    least((CASE {TIER.format('s.market_share')} WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END)::DOUBLE * (1 + 0.2 * (h - 1)), 1.0)::DOUBLE AS cap
  FROM now s JOIN trend t USING (market, id), range(1, {HORIZON + 1}) g(h))"""
NEEDS["raw_proj"] = ("trend", "now")
SQL["proj"] = """SELECT market, id, name, year, tier, s / (sum(s) OVER (PARTITION BY market, year)) * 100 AS market_share FROM raw_proj"""
NEEDS["proj"] = ("raw_proj",)
SQL["limits"] = """SELECT market, least(greatest(quantile_cont(g, 0.9) * 1.5, 40), 100) AS mx, least(greatest(quantile_cont(g, 0.1) * 1.5, -50), -20) AS mn FROM (
  SELECT market, CASE WHEN lag(year) OVER w = year - 1 THEN (market_share / lag(market_share) OVER w - 1) * 100 END AS g
  FROM shares WINDOW w AS (PARTITION BY market, id ORDER BY year)) GROUP BY 1"""
NEEDS["limits"] = ("shares",)
_prev = "SELECT market, id, market_share AS p FROM now"
for _h in range(1, HORIZON + 1):
    SQL[f"held{_h}"] = f"""SELECT market, id, name, year, tier, CASE WHEN g > mx * f THEN p * (1 + mx * f / 100) WHEN g < mn * f THEN p * (1 + mn * f / 100) ELSE market_share END AS s FROM (
      SELECT *, CASE WHEN p < 1 THEN 2.0 WHEN p < 5 THEN 1.5 ELSE 1.0 END AS f, least(greatest((market_share / p - 1) * 100, -90), 200) AS g FROM (
      SELECT j.*, CASE WHEN q.p > 0 THEN q.p ELSE 0.01 END AS p, l.mx, l.mn FROM proj j LEFT JOIN ({_prev}) q USING (market, id) JOIN limits l USING (market) JOIN (SELECT DISTINCT market, year AS ly FROM now) USING (market) WHERE j.year = ly + {_h}))"""
    SQL[f"norm{_h}"] = f"""SELECT market, id, name, year, tier, CASE WHEN x < 0.001 THEN 0.001 WHEN k > 0 AND a > 0 THEN x * (1 + (100 - k * 0.001 - a) / a) ELSE x END AS market_share FROM (
      SELECT *, count(*) FILTER (WHERE x < 0.001) OVER (PARTITION BY market) AS k, sum(x) FILTER (WHERE x >= 0.001) OVER (PARTITION BY market) AS a FROM (
      SELECT *, s * (100.0 / sum(s) OVER (PARTITION BY market)) AS x FROM held{_h}))"""
    NEEDS[f"held{_h}"] = ("proj", "limits") + ((f"norm{_h - 1}",) if _h > 1 else ())
    NEEDS[f"norm{_h}"] = (f"held{_h}",)
    _prev = f"SELECT market, id, market_share AS p FROM norm{_h}"
SQL["limited"] = " UNION ALL ".join(f"SELECT * FROM norm{h}" for h in range(1, HORIZON + 1))
NEEDS["limited"] = tuple(f"norm{h}" for h in range(1, HORIZON + 1))
SQL["world_rate"] = """SELECT market, max(year) AS last_year, arg_max(value, year) AS last_value, pow(arg_max(value, year) / arg_min(value, year), 1.0 / (max(year) - min(year))) - 1 AS rate FROM world GROUP BY 1"""
NEEDS["world_rate"] = ("world",)
SQL["world_all"] = f"SELECT market, year, value FROM world UNION ALL SELECT market, CAST(last_year + h AS INTEGER), last_value * pow(1 + rate, h) FROM world_rate, range(1, {HORIZON + 1}) g(h)"
NEEDS["world_all"] = ("world_rate",)
SQL["valued"] = f"""SELECT market, id, name, year, market_share, tier, market_share * w.value / 100 AS value FROM (
  SELECT market, id, name, year, market_share, {TIER.format('market_share')} AS tier FROM shares UNION ALL SELECT market, id, name, year, market_share, tier FROM limited) JOIN world_all w USING (market, year)"""
NEEDS["valued"] = ("limited", "world_all")
SQL["smooth1"] = """SELECT *, row_number() OVER (PARTITION BY market, id ORDER BY year) AS i, count(*) OVER (PARTITION BY market, id) AS n, first_value(tier) OVER (PARTITION BY market, id ORDER BY year) AS t,
  CASE WHEN lag(value) OVER (PARTITION BY market, id ORDER BY year) <> 0 THEN least(greatest((value / lag(value) OVER (PARTITION BY market, id ORDER BY year) - 1) * 100, -40), 80) END AS g FROM valued"""
NEEDS["smooth1"] = ("valued",)
SQL["smooth2"] = """SELECT *, CASE WHEN t IN (1, 2) THEN avg(g) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) WHEN t = 3 THEN avg(g) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
  ELSE avg(g) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) END AS sm,
  CASE t WHEN 1 THEN 35.0 WHEN 3 THEN 45.0 ELSE 40.0 END AS hi, CASE t WHEN 1 THEN -15.0 WHEN 3 THEN -25.0 ELSE -20.0 END AS lo, CASE t WHEN 1 THEN 15.0 WHEN 2 THEN 20.0 ELSE 25.0 END AS goal
  FROM smooth1 WINDOW w AS (PARTITION BY market, id ORDER BY year)"""
NEEDS["smooth2"] = ("smooth1",)
SQL["smooth3"] = """SELECT market, id, name, year, tier, i, n, value AS v, sm AS e, year AS y0, value AS orig FROM smooth2 WHERE i = 1 UNION ALL
  SELECT b.market, b.id, b.name, b.year, b.tier, b.i, b.n,
    a.v * (1 + ((1 - least(0.9, 0.25 * (b.year - a.y0))) * least(greatest(0.5 * b.sm + 0.5 * a.e, b.lo), b.hi) + least(0.9, 0.25 * (b.year - a.y0)) * b.goal) / 100),
    0.5 * b.sm + 0.5 * a.e, a.y0, b.value FROM smooth3 a JOIN smooth2 b ON b.market = a.market AND b.id = a.id AND b.i = a.i + 1"""
NEEDS["smooth3"] = ("smooth2",)
SQL["smoothed"] = """SELECT market, id, name, year, tier, x * was / is_ AS value, x * was / is_ / was * 100 AS market_share FROM (
  SELECT *, sum(orig) OVER (PARTITION BY market, year) AS was, sum(x) OVER (PARTITION BY market, year) AS is_ FROM (SELECT *, CASE WHEN n >= 3 THEN v ELSE orig END AS x FROM smooth3))"""
NEEDS["smoothed"] = ("smooth3",)

ROW = dict(market="string", id="bigint", year="int")


@query("d01_market_share", ctes("shares") + f"SELECT market, id, year, {r('market_share')} AS market_share FROM shares")
def _(spark, sf):
    return tidy(shares(spark, sf), **ROW, market_share=6)


_ZERO = ctes("history", z="SELECT market, id, year, CASE WHEN year = 1997 THEN 0 ELSE value END AS value FROM history",
             t="SELECT market, year, sum(value) AS total FROM z GROUP BY 1, 2")


@query("d02_zero_years", _ZERO + f"""SELECT market, id, year, 'skip' AS policy, {r('value / total * 100')} AS market_share, false AS flagged FROM z JOIN t USING (market, year) WHERE total > 0
  UNION ALL SELECT market, id, year, 'interpolate', CASE WHEN total > 0 THEN {r('value / total * 100')} END, NOT total > 0 FROM z JOIN t USING (market, year)
  UNION ALL SELECT market, id, year, 'zero', CASE WHEN total > 0 THEN {r('value / total * 100')} ELSE 0 END, false FROM z JOIN t USING (market, year)""")
def _(spark, sf):
    z = history(spark, sf).withColumn("value", F.when(F.col("year") == 1997, F.lit(0.0)).otherwise(F.col("value")))
    out = None
    for policy in ("skip", "interpolate", "zero"):
        d = sh.market_shares(z, zero_policy=policy).withColumn("policy", F.lit(policy))
        d = d.withColumn("flagged", F.col("needs_interpolation") if policy == "interpolate" else F.lit(False))
        d = d.select("market", "id", "year", "policy", "market_share", "flagged")
        out = d if out is None else out.unionByName(d)
    return tidy(out, **ROW, policy="string", market_share=6, flagged="boolean")


@query("d03_one_entity_market", f"SELECT l_suppkey AS market, year(l_shipdate)::INTEGER AS year, CASE WHEN sum(l_extendedprice) > 0 THEN 100.0::DOUBLE END AS market_share, 1 AS tier FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    one = history(spark, sf).select(F.col("id").alias("market"), "id", "name", "year", "value").groupBy("market", "id", "name", "year").agg(F.sum("value").alias("value"))
    out = sh.market_shares(one).withColumn("tier", sh.tier_of("market_share", (5.0, 1.0, 0.1)))
    return tidy(out, market="bigint", year="int", market_share=6, tier="int")


@query("d04_share_trends", ctes("trend") + f"SELECT market, id, {r('trend_factor')} AS trend_factor FROM trend")
def _(spark, sf):
    return tidy(sh.share_trends(shares(spark, sf)), market="string", id="bigint", trend_factor=6)


@query("d05_market_phase", ctes("phase") + f"SELECT market, id, {r('mean_change')} AS mean_change, {r('std_change')} AS std_change, phase FROM phase")
def _(spark, sf):
    return tidy(sh.phases(shares(spark, sf)), market="string", id="bigint", mean_change=6, std_change=6, phase="string")


@query("d06_growth_bounds", ctes("phase", "bounds", "now", t="SELECT market, id, " + TIER.format("market_share") + " AS tier FROM now",
                                 f="SELECT * FROM (VALUES (1, 1.5, 0.7), (2, 1.2, 0.9), (3, 1.0, 1.0), (4, 0.8, 1.2)) f(tier, a, b)") +
       f"SELECT market, id, phase, tier, {r('lo * a')} AS low, {r('hi * b')} AS high FROM phase JOIN bounds USING (phase) JOIN t USING (market, id) JOIN f USING (tier)")
def _(spark, sf):
    s = shares(spark, sf)
    latest = latest_slice(s).select("market", "id", sh.tier_of("market_share", THRESHOLDS).alias("tier"))
    low, high = sh.bound_columns(F.col("phase"), F.col("tier"))
    return tidy(sh.phases(s).join(latest, ["market", "id"]).withColumn("low", low).withColumn("high", high),
                market="string", id="bigint", phase="string", tier="int", low=6, high=6)


@query("d08_manual_tiers", ctes("shares") + """SELECT market, year, CASE WHEN market_share >= 5 THEN 1 WHEN market_share >= 1 THEN 2 WHEN market_share >= 0.1 THEN 3 ELSE 4 END AS tier, count(*)::BIGINT AS n FROM shares GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = shares(spark, sf).withColumn("tier", sh.tier_of("market_share", DistributionSettings().tier_thresholds))
    return tidy(d.groupBy("market", "year", "tier").agg(F.count(F.lit(1)).alias("n")), market="string", year="int", tier="int", n="bigint")


@query("d09_assign_tier", ctes("parts", t="SELECT market, year, sum(value) AS total FROM parts GROUP BY 1, 2") +
       f"SELECT market, id, year, {TIER.format('value / total * 100')} AS tier FROM parts JOIN t USING (market, year)")
def _(spark, sf):
    d = sh.market_shares(parts(spark, sf)).withColumn("tier", sh.tier_of("market_share", THRESHOLDS))
    return tidy(d, **ROW, tier="int")


@query("d10_project_shares", ctes("proj") + f"SELECT market, id, year, tier, {r('market_share')} AS market_share FROM proj")
def _(spark, sf):
    return tidy(sh.project_shares(shares(spark, sf), HORIZON, SET), **ROW, tier="int", market_share=6)


@query("d11_tier_caps", ctes("now") + f"""SELECT market, id, CAST(year + h AS INTEGER) AS year, {r("least((CASE " + TIER.format('market_share') + " WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 ELSE 0.5 END)::DOUBLE * (1 + 0.2 * (h - 1)), 1.0)")} AS cap
  FROM now, range(1, 9) g(h)""")
def _(spark, sf):
    d = latest_slice(shares(spark, sf)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(8))))
    d = d.withColumn("cap", sh.tier_change_cap(sh.tier_of("market_share", THRESHOLDS), F.col("h"))).withColumn("year", F.col("year") + F.col("h"))
    return tidy(d, **ROW, cap=6)


@query("d12_growth_limits", ctes("limits") + f"SELECT market, {r('mx')} AS max_growth_rate, {r('mn')} AS min_growth_rate FROM limits")
def _(spark, sf):
    return tidy(sh.growth_limits(shares(spark, sf)), market="string", max_growth_rate=6, min_growth_rate=6)


@query("d13_limit_growth", ctes("limited") + f"SELECT market, id, year, tier, {r('market_share')} AS market_share FROM limited")
def _(spark, sf):
    s = cut_lineage(shares(spark, sf))
    out = sh.limit_growth(sh.project_shares(s, HORIZON, SET), s, HORIZON, sh.growth_limits(s), SET)
    return tidy(out, **ROW, tier="int", market_share=6)


@query("d14_carry_years", ctes("now", "world_all") + f"""SELECT market, id, year, {r('market_share')} AS market_share FROM shares
  UNION ALL SELECT s.market, s.id, w.year, {r('s.market_share')} FROM now s JOIN world_all w ON w.market = s.market AND w.year > s.year""")
def _(spark, sf):
    w = fc.extend_total(world(spark, sf), HORIZON)
    return tidy(sh.carry_missing_years(shares(spark, sf), w), **ROW, market_share=6)


@query("d15_values", ctes("valued") + f"SELECT market, id, year, {r('market_share')} AS market_share, {r('value', 4)} AS value FROM valued")
def _(spark, sf):
    s = cut_lineage(shares(spark, sf))
    lim = sh.limit_growth(sh.project_shares(s, HORIZON, SET), s, HORIZON, sh.growth_limits(s), SET)
    cols = ["market", "id", "year", "market_share"]
    out = sh.distribute_values(s.select(*cols).unionByName(lim.select(*cols)), fc.extend_total(world(spark, sf), HORIZON))
    return tidy(out, **ROW, market_share=6, value=4)


_GAPS = """SELECT l_suppkey AS market, year(l_shipdate)::INTEGER AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem
  WHERE year(l_shipdate) NOT IN (1997, 1998) GROUP BY 1, 2"""


@query("d16_fill_total", ctes(k=_GAPS, m="SELECT DISTINCT market FROM k", y="SELECT market, CAST(v AS INTEGER) AS year FROM m, range(1993, 2005) g(v)",
                              b="SELECT market, arg_min(value, year) AS v1, min(year) AS y1, arg_max(value, year) AS vn, max(year) AS yn FROM k GROUP BY 1",
                              c="SELECT k.market, arg_min(k.value, k.year) AS v2, min(k.year) AS y2 FROM k JOIN b ON b.market = k.market AND k.year > b.y1 GROUP BY 1",
                              d="SELECT k.market, arg_max(k.value, k.year) AS vp, max(k.year) AS yp FROM k JOIN b ON b.market = k.market AND k.year < b.yn GROUP BY 1") + f"""
  SELECT y.market, y.year, {r('''CASE WHEN k.value IS NOT NULL THEN k.value WHEN y.year IN (1997, 1998) THEN e.value + (y.year - 1996)::DOUBLE / 3 * (f.value - e.value)
    WHEN y.year > yn THEN vn + (vn - vp) / (yn - yp) * (y.year - yn) ELSE v1 - (v2 - v1) / (y2 - y1) * (y1 - y.year) END''', 4)} AS value,
    CASE WHEN k.value IS NOT NULL THEN 'known' WHEN y.year IN (1997, 1998) THEN 'linear' WHEN y.year > yn THEN 'trend' ELSE 'reverse_trend' END AS rule
  FROM y LEFT JOIN k USING (market, year) JOIN b USING (market) JOIN c USING (market) JOIN d USING (market)
  LEFT JOIN k e ON e.market = y.market AND e.year = 1996 LEFT JOIN k f ON f.market = y.market AND f.year = 1999""")
def _(spark, sf):
    from panelloom.plans.base import trade
    known = trade(spark, sf).where("year not in (1997, 1998)").select(F.col("id").alias("market"), "year", "value")
    years = known.select("market").distinct().withColumn("year", F.explode(F.sequence(F.lit(1993), F.lit(2004))))
    return tidy(sh.fill_total_series(known, years), market="bigint", year="int", value=4, rule="string")


@query("d17_year_spine", "SELECT o_custkey AS id, CAST(unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS INTEGER) AS year FROM orders GROUP BY 1")
def _(spark, sf):
    from panelloom.operators.quality import year_spine
    from panelloom.plans.base import table
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"))
    return year_spine(p, ["id"], DEFAULT).select("id", F.col("year").cast("int").alias("year"))


@query("d18_smoothing", ctes("smoothed") + f"SELECT market, id, year, {r('value', 4)} AS value, {r('market_share')} AS market_share FROM smoothed")
def _(spark, sf):
    out = sh.distribute(history(spark, sf), fc.extend_total(world(spark, sf), HORIZON), HORIZON, DistributionSettings(tier_thresholds=THRESHOLDS))
    return tidy(out, **ROW, value=4, market_share=6)


@query("d19_splice", ctes("shares", "proj") + f"""SELECT market, id, year, {r('market_share')} AS market_share, 'kept' AS origin FROM shares WHERE year < 1999
  UNION ALL SELECT market, id, year, {r('market_share * 1.01')}, 'recomputed' FROM shares WHERE year >= 1999 UNION ALL SELECT market, id, year, {r('market_share')}, 'recomputed' FROM proj""")
def _(spark, sf):
    s = shares(spark, sf).select("market", "id", "name", "year", "market_share")
    again = s.where("year >= 1998").withColumn("market_share", F.col("market_share") * 1.01).where("year >= 1999")
    again = again.unionByName(sh.project_shares(s, HORIZON, SET).drop("tier")).withColumn("origin", F.lit("recomputed"))
    return tidy(sh.splice(s.withColumn("origin", F.lit("kept")), again, 1999), **ROW, market_share=6, origin="string")


@query("d20_rescale", ctes("history", "world") + f"""SELECT market, id, year, {r('h.value * 1.05 * w.value / sum(h.value * 1.05) OVER (PARTITION BY market, year)', 4)} AS value FROM history h JOIN world w USING (market, year)""")
def _(spark, sf):
    h = history(spark, sf).withColumn("value", F.col("value") * 1.05)
    return tidy(sh.rescale_to_total(h, world(spark, sf)), **ROW, value=4)


SQL["closure"] = """SELECT DISTINCT parent AS ancestor, child AS descendant, 1 AS depth FROM edges UNION
  SELECT c.ancestor, e.child, c.depth + 1 FROM closure c JOIN edges e ON e.parent = c.descendant"""
NEEDS["closure"] = ("edges",)
SQL["leaf"] = "SELECT ancestor AS region, descendant AS leaf, min(depth) AS depth FROM closure WHERE descendant NOT IN (SELECT parent FROM edges) GROUP BY 1, 2"
NEEDS["leaf"] = ("closure",)


@query("d21_distribute", ctes("smoothed", "leaf") + f"""SELECT market, name, year, 'entity' AS region_type, tier, {r('value', 4)} AS value, {r('market_share')} AS market_share FROM smoothed
  UNION ALL SELECT market, region, year, 'region', NULL, {r('sum(value)', 2)}, NULL FROM smoothed JOIN leaf ON leaf = name GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = sh.distribute(history(spark, sf), fc.extend_total(world(spark, sf), HORIZON), HORIZON, DistributionSettings(tier_thresholds=THRESHOLDS),
                        regions=rg.leaves(edges(spark, sf)))
    out = out.withColumn("value", F.when(F.col("region_type") == "entity", F.round("value", 4)).otherwise(F.round("value", 2)))
    return tidy(out, market="string", name="string", year="int", region_type="string", tier="int", value=4, market_share=6)
