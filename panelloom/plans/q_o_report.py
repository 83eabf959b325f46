"""Reporting tables."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage
from panelloom.operators import regions as rg, report as rp, shares as sh
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import NEEDS, SQL, ctes, history, mapping, parts, query, r, tidy
from panelloom.roles import DEFAULT

ONE = DEFAULT.with_(by=())
KEY = dict(market="string", id="bigint")
ROW = dict(**KEY, year="int")
YEARS = list(range(1995, 2002))


def fixed_parts(spark, sf):
    return parts(spark, sf)


SQL["fixed"] = "SELECT * FROM parts"
NEEDS["fixed"] = ("parts",)
SQL["pshares"] = "SELECT f.*, value / sum(value) OVER (PARTITION BY market, year) * 100 AS market_share FROM fixed f"
NEEDS["pshares"] = ("fixed",)
SQL["yoy"] = """SELECT market, id, year, value, market_share, value - lag(value) OVER w AS vc, (value / nullif(lag(value) OVER w, 0) - 1) * 100 AS vp, market_share - lag(market_share) OVER w AS sc,
  (market_share / nullif(lag(market_share) OVER w, 0) - 1) * 100 AS sp FROM pshares WINDOW w AS (PARTITION BY market, id ORDER BY year)"""
NEEDS["yoy"] = ("pshares",)
SQL["profile"] = """SELECT market, id, count(*) AS years, arg_min(value, year) AS v0, arg_max(value, year) AS v1, arg_max(market_share, year) AS s1,
  CASE WHEN max(year) > min(year) THEN (pow(arg_max(value, year) / arg_min(value, year), 1.0 / (max(year) - min(year))) - 1) * 100 ELSE 0 END AS cagr,
  coalesce(avg(vp), 0) AS mg, coalesce(stddev_pop(vp), 0) AS vol, CASE WHEN count(vp) > 2 THEN regr_slope(vp, CASE WHEN vp IS NOT NULL THEN i END) ELSE 0 END AS acc,
  CASE WHEN max(year) > min(year) THEN (pow(arg_max(market_share, year) / arg_min(market_share, year), 1.0 / (max(year) - min(year))) - 1) * 100 ELSE 0 END AS sg
  FROM (SELECT *, row_number() OVER (PARTITION BY market, id ORDER BY year) AS i FROM yoy) GROUP BY 1, 2 HAVING count(*) >= 2"""
NEEDS["profile"] = ("yoy",)
SQL["regional"] = "SELECT h.market, h.id, h.name, h.year, h.value, coalesce(m.region, 'Others') AS region FROM history h LEFT JOIN mapping m ON m.name = h.name"
NEEDS["regional"] = ("history", "mapping")


def regional(spark, sf):
    return rg.add_region(history(spark, sf), mapping(spark, sf))


@query("o01_concentration", ctes("fixed", x="SELECT *, value / sum(value) OVER w AS s, row_number() OVER (PARTITION BY market, year ORDER BY value DESC, id) AS d, row_number() OVER (PARTITION BY market, year ORDER BY value, id) AS a, count(*) OVER w AS n FROM fixed WINDOW w AS (PARTITION BY market, year)") + f"""
  SELECT market, year, max(n)::BIGINT AS entities, {r('sum(s * s) * 10000')} AS hhi, {r('sum(s) FILTER (WHERE d <= 4) * 100')} AS cr4, {r('sum(s) FILTER (WHERE d <= 8) * 100')} AS cr8,
  {r('2 * sum(a * s) / max(n) - (max(n) + 1)::DOUBLE / max(n)')} AS gini, {r('-sum(s * log2(s + 1e-10))')} AS entropy FROM x GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(rp.concentration(fixed_parts(spark, sf), ["market", "year"]), market="string", year="int", entities="bigint", hhi=6, cr4=6, cr8=6, gini=6, entropy=6)


@query("o02_growth_profile", ctes("profile") + f"""SELECT market, id, years::BIGINT AS years, {r('v0', 2)} AS initial_value, {r('v1', 2)} AS latest_value, {r('s1')} AS latest_share, {r('cagr')} AS cagr,
  {r('mg')} AS mean_growth, {r('vol')} AS volatility, {r('acc')} AS acceleration, {r('sg')} AS share_growth FROM profile""")
def _(spark, sf):
    return tidy(rp.growth_profile(fixed_parts(spark, sf)), **KEY, years="bigint", initial_value=2, latest_value=2, latest_share=6, cagr=6, mean_growth=6,
                volatility=6, acceleration=6, share_growth=6)


@query("o03_yearly_changes", ctes("yoy") + f"SELECT market, id, year, {r('vc', 2)} AS value_change, {r('vp')} AS value_change_pct, {r('sc')} AS share_change, {r('sp')} AS share_change_pct FROM yoy")
def _(spark, sf):
    return tidy(rp.yearly_changes(sh.market_shares(fixed_parts(spark, sf))), **ROW, value_change=2, value_change_pct=6, share_change=6, share_change_pct=6)


@query("o04_growth_by_join", ctes("fixed") + f"SELECT a.market, a.id, a.year, {r('(a.value / b.value - 1) * 100')} AS growth_rate FROM fixed a JOIN fixed b ON a.market = b.market AND a.id = b.id AND a.year = b.year + 1")
def _(spark, sf):
    return tidy(rp.growth_by_join(fixed_parts(spark, sf)), **ROW, growth_rate=6)


@query("o05_cagr_between", ctes("fixed") + f"SELECT a.market, a.id, {r('(pow(b.value / a.value, 1.0 / 4) - 1) * 100')} AS cagr FROM fixed a JOIN fixed b USING (market, id) WHERE a.year = 1996 AND b.year = 2000")
def _(spark, sf):
    return tidy(rp.cagr_between(fixed_parts(spark, sf), 1996, 2000), **KEY, cagr=6)


@query("o05_cagr_windows", ctes("fixed", l="SELECT market, id, max(year) AS y, arg_max(value, year) AS v FROM fixed GROUP BY 1, 2") +
       f"SELECT l.market, l.id, CAST(s AS INTEGER) AS span, {r('(pow(l.v / f.value, 1.0 / s) - 1) * 100')} AS cagr FROM l CROSS JOIN (VALUES (3), (5), (7)) t(s) JOIN fixed f ON f.market = l.market AND f.id = l.id AND f.year = l.y - s")
def _(spark, sf):
    return tidy(rp.cagr_windows(fixed_parts(spark, sf)), **KEY, span="int", cagr=6)


@query("o06_movers", ctes("yoy", u="SELECT *, row_number() OVER (PARTITION BY market ORDER BY vp DESC, id) AS a, row_number() OVER (PARTITION BY market ORDER BY vp, id) AS b FROM yoy WHERE year = 2001 AND vp IS NOT NULL") + f"""
  SELECT market, id, 'gain' AS side, a::INTEGER AS rank, {r('vp')} AS value_change_pct FROM u WHERE a <= 5 UNION ALL SELECT market, id, 'loss', b::INTEGER, {r('vp')} FROM u WHERE b <= 5""")
def _(spark, sf):
    return tidy(rp.movers(fixed_parts(spark, sf), 2001), **KEY, side="string", rank="int", value_change_pct=6)


@query("o07_growth_consistency", ctes("yoy") + "SELECT market, id, " + ", ".join(
    f"{r(f'coalesce(avg({c}), 0)')} AS mean_{k}_growth, {r(f'coalesce(stddev_samp({c}), 0)')} AS {k}_volatility, {r(f'100.0 * count(*) FILTER (WHERE {c} > 0) / count({c})')} AS positive_{k}_years"
    for k, c in (("value", "vp"), ("share", "sp"))) + " FROM yoy GROUP BY 1, 2 HAVING count(vp) > 0")
def _(spark, sf):
    return tidy(rp.growth_consistency(fixed_parts(spark, sf)), **KEY, mean_value_growth=6, value_volatility=6, positive_value_years=6, mean_share_growth=6, share_volatility=6, positive_share_years=6)


@query("o08_market_statistics", ctes("fixed", t="SELECT market, year, sum(CAST(value AS DECIMAL(28,2)))::DOUBLE AS t FROM fixed GROUP BY 1, 2",
                                     m="SELECT market, arg_min(t, year) AS a, arg_max(t, year) AS b FROM t GROUP BY 1",
                                     k="SELECT *, row_number() OVER (PARTITION BY market ORDER BY value DESC, id) AS rank FROM fixed WHERE year = 2001") + f"""
  SELECT market, 1995 AS first_year, 2001 AS last_year, {r('a', 2)} AS first_total, {r('b', 2)} AS last_total, {r('b / a')} AS multiple, {r('(pow(b / a, 1.0 / 6) - 1) * 100')} AS total_cagr, rank::INTEGER AS rank, k.id,
  {r('k.value', 2)} AS final_value, {r('k.value / b * 100')} AS final_share, {r('(pow(k.value / f.value, 1.0 / 6) - 1) * 100')} AS cagr
  FROM k JOIN m USING (market) LEFT JOIN fixed f ON f.market = k.market AND f.id = k.id AND f.year = 1995 WHERE rank <= 5""")
def _(spark, sf):
    return tidy(rp.market_statistics(fixed_parts(spark, sf)), market="string", first_year="int", last_year="int", first_total=2, last_total=2, multiple=6, total_cagr=6, rank="int", id="bigint",
                final_value=2, final_share=6, cagr=6)


@query("o09_top_per_year", ctes("fixed") + f"SELECT market, id, year, rank::INTEGER AS rank, {r('value', 2)} AS value FROM (SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY value DESC, id) AS rank FROM fixed) WHERE rank <= 10")
def _(spark, sf):
    return tidy(rp.top_per_year(fixed_parts(spark, sf), 10), **ROW, rank="int", value=2)


@query("o09_leaders_history", ctes("fixed", k="SELECT market, id FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY value DESC, id) AS rank FROM fixed WHERE year = 2001) WHERE rank <= 15") +
       f"SELECT market, id, year, {r('value', 2)} AS value FROM fixed SEMI JOIN k USING (market, id)")
def _(spark, sf):
    return tidy(rp.history_of_leaders(fixed_parts(spark, sf), 15), **ROW, value=2)


@query("o10_share_evolution", ctes("pshares", m="SELECT market, id, avg(market_share) AS ms FROM pshares GROUP BY 1, 2",
                                   k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ms DESC, id) AS rank FROM m) WHERE rank <= 10") +
       f"SELECT market, id, year, {r('market_share')} AS market_share, {r('ms')} AS mean_share, rank::INTEGER AS rank FROM pshares JOIN k USING (market, id)")
def _(spark, sf):
    return tidy(rp.share_evolution(fixed_parts(spark, sf)), **ROW, market_share=6, mean_share=6, rank="int")


@query("o11_positioning", ctes("yoy", l="SELECT market, id, arg_max(value, year) AS size, arg_max(vp, year) AS growth FROM yoy WHERE vp IS NOT NULL GROUP BY 1, 2",
                               m="SELECT market, median(size) AS ms, median(growth) AS mg FROM l GROUP BY 1") + f"""
  SELECT market, id, {r('size', 2)} AS size, {r('growth')} AS growth, CASE WHEN size >= ms AND growth >= mg THEN 'leader' WHEN size >= ms THEN 'established' WHEN growth >= mg THEN 'challenger' ELSE 'niche' END AS quadrant FROM l JOIN m USING (market)""")
def _(spark, sf):
    return tidy(rp.positioning(fixed_parts(spark, sf)), **KEY, size=2, growth=6, quadrant="string")


@query("o11_risk_return", ctes("profile", m="SELECT market, avg(cagr) AS a, avg(vol) AS b FROM profile GROUP BY 1") + f"""
  SELECT market, id, {r('cagr')} AS cagr, {r('vol')} AS volatility, CASE WHEN cagr >= a AND vol < b THEN 'star' WHEN cagr >= a THEN 'growth' WHEN vol < b THEN 'stable' ELSE 'risk' END AS quadrant,
  CASE WHEN vol < b * 0.5 THEN 'low' WHEN vol > b * 1.5 THEN 'high' ELSE 'middle' END AS volatility_class FROM profile JOIN m USING (market)""")
def _(spark, sf):
    return tidy(rp.risk_return(rp.growth_profile(fixed_parts(spark, sf))), **KEY, cagr=6, volatility=6, quadrant="string", volatility_class="string")


@query("o12_waterfall", ctes("fixed", b="SELECT coalesce(x.market, y.market) AS market, coalesce(x.id, y.id) AS id, coalesce(x.value, 0) AS f, coalesce(y.value, 0) AS l FROM (SELECT * FROM fixed WHERE year = 1995) x FULL JOIN (SELECT * FROM fixed WHERE year = 2001) y ON x.market = y.market AND x.id = y.id",
                             t="SELECT market, sum(f) AS ft, sum(l) AS lt FROM b GROUP BY 1", k="SELECT *, row_number() OVER (PARTITION BY market ORDER BY l DESC, id) AS rank FROM b") + f"""
  SELECT market, id, rank::INTEGER AS rank, {r('l - f', 2)} AS contribution, {r('ft', 2)} AS first_total, {r('lt', 2)} AS last_total, {r('ft + sum(l - f) OVER (PARTITION BY market ORDER BY rank)', 2)} AS level FROM k JOIN t USING (market) WHERE rank <= 10""")
def _(spark, sf):
    return tidy(rp.waterfall(fixed_parts(spark, sf), 1995, 2001), **KEY, rank="int", contribution=2, first_total=2, last_total=2, level=2)


SQL["rsum"] = """SELECT market, region, t, a, n, s, t / sum(t) OVER (PARTITION BY market) * 100 AS ms, s / a * 100 AS cv FROM (
  SELECT market, region, sum(value) AS t, avg(value) AS a, count(value) AS n, stddev_samp(value) AS s FROM regional GROUP BY 1, 2)"""
NEEDS["rsum"] = ("regional",)
SQL["rmet"] = """SELECT market, arg_max(region, t) AS d, count(*) AS n, sum(ms / 100 * ms / 100) * 10000 AS hhi, max(ms) AS top, avg(cv) AS cv FROM rsum GROUP BY 1"""
NEEDS["rmet"] = ("rsum",)


@query("o13_region_summary", ctes("rsum") + f"SELECT market, region, {r('t', 2)} AS total, {r('a')} AS average, n::BIGINT AS entries, {r('s', 4)} AS deviation, {r('ms')} AS market_share, {r('cv')} AS variation FROM rsum")
def _(spark, sf):
    return tidy(rp.region_summary(regional(spark, sf)), market="string", region="string", total=2, average=6, entries="bigint", deviation=4, market_share=6, variation=6)


@query("o13_region_metrics", ctes("rmet") + f"SELECT market, d AS dominant_region, n::BIGINT AS regions, {r('hhi')} AS hhi, {r('top')} AS top_share, CASE WHEN hhi > 2500 THEN 'High' WHEN hhi > 1500 THEN 'Moderate' ELSE 'Low' END AS level FROM rmet")
def _(spark, sf):
    return tidy(rp.region_metrics(rp.region_summary(regional(spark, sf))), market="string", dominant_region="string", regions="bigint", hhi=6, top_share=6, level="string")


SQL["rgrow"] = "SELECT market, region, year, v, (v / lag(v) OVER (PARTITION BY market, region ORDER BY year) - 1) * 100 AS g FROM (SELECT market, region, year, sum(value) AS v FROM regional GROUP BY 1, 2, 3)"
NEEDS["rgrow"] = ("regional",)


@query("o13_region_growth", ctes("rgrow") + f"SELECT market, region, year, {r('v', 2)} AS value, {r('g')} AS growth_rate FROM rgrow")
def _(spark, sf):
    return tidy(rp.region_growth(regional(spark, sf)), market="string", region="string", year="int", value=2, growth_rate=6)


@query("o13_region_radar", ctes("regional", m="SELECT market, region, avg(value) AS value, avg(id) AS id FROM regional GROUP BY 1, 2") + f"""SELECT market, region,
  {r('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100')} AS value_index, {r('(id - min(id) OVER w) / (max(id) OVER w - min(id) OVER w) * 100')} AS id_index FROM m WINDOW w AS (PARTITION BY market)""")
def _(spark, sf):
    return tidy(rp.region_radar(regional(spark, sf), ["value", "id"]), market="string", region="string", value_index=6, id_index=6)


@query("o14_yearly_ranks", ctes("fixed") + f"SELECT market, id, year, {r('value', 2)} AS value, rank() OVER (PARTITION BY market, year ORDER BY value DESC)::BIGINT AS rank FROM fixed")
def _(spark, sf):
    return tidy(rp.yearly_ranks(fixed_parts(spark, sf)), **ROW, value=2, rank="bigint")


SQL["exec"] = """SELECT market, year, t, n, t / lag(t) OVER (PARTITION BY market ORDER BY year) * 100 - 100 AS g, t1 / t * 100 AS s1, t3 / t * 100 AS s3, t5 / t * 100 AS s5, t10 / t * 100 AS s10 FROM (
  SELECT market, year, sum(value) AS t, count(*) AS n, sum(value) FILTER (WHERE k <= 1) AS t1, sum(value) FILTER (WHERE k <= 3) AS t3, sum(value) FILTER (WHERE k <= 5) AS t5, sum(value) FILTER (WHERE k <= 10) AS t10
  FROM (SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY value DESC, id) AS k FROM fixed) GROUP BY 1, 2)"""
NEEDS["exec"] = ("fixed",)


@query("o15_executive", ctes("exec") + f"SELECT market, year, {r('t', 2)} AS total, n::BIGINT AS entities, {r('g')} AS growth_rate, {r('s1')} AS top1_share, {r('s3')} AS top3_share, {r('s5')} AS top5_share, {r('s10')} AS top10_share FROM exec")
def _(spark, sf):
    return tidy(rp.executive(fixed_parts(spark, sf)), market="string", year="int", total=2, entities="bigint", growth_rate=6, top1_share=6, top3_share=6, top5_share=6, top10_share=6)


@query("o16_subtotals", ctes("regional") + f"SELECT region, year, {r('sum(CAST(value AS DECIMAL(28,2)))', 2)} AS total, count(*)::BIGINT AS entries, grouping_id(region, year)::BIGINT AS level FROM regional GROUP BY ROLLUP (region, year)")
def _(spark, sf):
    return tidy(rp.subtotals(regional(spark, sf)), region="string", year="int", total=2, entries="bigint", level="bigint")


@query("o17_table_view", ctes("history") + f"SELECT market, id, year, {r('value', 2)} AS value FROM history WHERE year BETWEEN 1997 AND 1999 ORDER BY year DESC, h.value DESC, id LIMIT 100".replace("FROM history", "FROM history h"))
def _(spark, sf):
    return tidy(rp.table_view(history(spark, sf), (1997, 1999), limit=100), **ROW, value=2)


@query("o18_share_table", ctes("history", k="SELECT *, row_number() OVER (PARTITION BY market ORDER BY value DESC, id) AS k FROM history WHERE year = 2001") + f"""
  SELECT market, CASE WHEN k <= 10 THEN name ELSE 'Others' END AS label, {r('sum(value)', 2)} AS value, {r('sum(value) / max(t) * 100')} AS market_share FROM (SELECT *, sum(value) OVER (PARTITION BY market) AS t FROM k) GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(rp.share_table(history(spark, sf), 2001, 10), market="string", label="string", value=2, market_share=6)


@query("o19_market_insights", ctes("exec", e="SELECT * FROM exec WHERE year = 2001", q="SELECT e.market, count(*) FILTER (WHERE f.value < e.t * 0.01)::DOUBLE / count(*) AS small FROM fixed f JOIN e ON e.market = f.market AND e.year = f.year GROUP BY 1") + f"""
  SELECT market, rule, fired, {r('value')} AS value FROM (
  SELECT market, 'leader_dominates' AS rule, s1 > 50 AS fired, s1 AS value FROM e UNION ALL SELECT market, 'leader_leads', s1 > 30 AND s1 <= 50, s1 FROM e
  UNION ALL SELECT market, 'top_three_concentrated', s3 > 80, s3 FROM e UNION ALL SELECT market, 'healthy_competition', s3 < 50, s3 FROM e
  UNION ALL SELECT market, 'many_small_entities', small > 0.5, small * 100 FROM q UNION ALL SELECT market, 'total_grew', g > 0, g FROM e)""")
def _(spark, sf):
    return tidy(rp.market_insights(fixed_parts(spark, sf)), market="string", rule="string", fired="boolean", value=6)


@query("o20_region_insights", ctes("rmet", "rgrow", g="SELECT market, count(*) FILTER (WHERE g > 10) AS n FROM rgrow WHERE year = 2001 GROUP BY 1") + f"""SELECT market, rule, fired, {r('value')} AS value FROM (
  SELECT market, 'dominant_region' AS rule, true AS fired, top AS value FROM rmet UNION ALL SELECT market, 'high_concentration', hhi > 2500, hhi FROM rmet
  UNION ALL SELECT market, 'well_distributed', hhi <= 1500, hhi FROM rmet UNION ALL SELECT market, 'global_presence', n >= 4, n FROM rmet UNION ALL SELECT market, 'multi_region', n = 3, n FROM rmet
  UNION ALL SELECT market, 'focused', n < 3, n FROM rmet UNION ALL SELECT market, 'uneven', cv > 100, cv FROM rmet UNION ALL SELECT market, 'even', cv < 50, cv FROM rmet
  UNION ALL SELECT market, 'growing_regions', n > 0, n FROM g)""")
def _(spark, sf):
    return tidy(rp.region_insights(cut_lineage(regional(spark, sf))), market="string", rule="string", fired="boolean", value=6)


@query("o21_bubbles", ctes("yoy", k="SELECT market, id FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY value DESC, id) AS rank FROM fixed WHERE year = 2001) WHERE rank <= 10") +
       f"SELECT market, id, year, {r('value', 2)} AS value, {r('vp')} AS value_change_pct FROM yoy SEMI JOIN k USING (market, id) WHERE vp IS NOT NULL")
def _(spark, sf):
    return tidy(rp.bubbles(fixed_parts(spark, sf), 10), **ROW, value=2, value_change_pct=6)


@query("o22_region_totals", ctes("regional") + f"SELECT market, region, year, {r('sum(CAST(value AS DECIMAL(28,2)))', 2)} AS total, region <> 'Others' AS assigned FROM regional GROUP BY 1, 2, 3")
def _(spark, sf):
    return tidy(rp.region_totals(history(spark, sf), mapping(spark, sf)), market="string", region="string", year="int", total=2, assigned="boolean")


def _pivot(src, expr, keys, digits=2):
    return f"SELECT {keys}, " + ", ".join(f'{r(expr.format(y=y), digits)} AS "{y}"' for y in YEARS) + f" FROM {src} GROUP BY {keys}"


_COLS = {str(y): 2 for y in YEARS}


@query("o23_size_sheet", ctes("history") + _pivot("history", "sum(value) FILTER (WHERE year = {y})", "market, id, name"))
def _(spark, sf):
    return tidy(rp.report_sheet(history(spark, sf), YEARS, "size"), **KEY, name="string", **_COLS)


@query("o23_growth_sheet", ctes("history", g="SELECT market, id, name, year, (value / lag(value) OVER (PARTITION BY market, id ORDER BY year) - 1) * 100 AS g FROM history") + _pivot("g", "max(g) FILTER (WHERE year = {y})", "market, id, name", 6))
def _(spark, sf):
    return tidy(rp.report_sheet(history(spark, sf), YEARS, "growth"), **KEY, name="string", **{str(y): 6 for y in YEARS})


@query("o23_region_sheet", ctes("regional") + _pivot("regional", "sum(CAST(value AS DECIMAL(28,2))) FILTER (WHERE year = {y})", "market, region"))
def _(spark, sf):
    return tidy(rp.report_sheet(regional(spark, sf), YEARS, "region"), market="string", region="string", **_COLS)


@query("o24_size_view", ctes("fixed") + _pivot("fixed", "coalesce(sum(value) FILTER (WHERE year = {y}), 0)", "market, id"))
def _(spark, sf):
    return tidy(rp.size_view(fixed_parts(spark, sf), YEARS), **KEY, **_COLS)


@query("o25_cagr_histogram", ctes("profile") + f"SELECT market, CASE WHEN cagr < -50 THEN 0 WHEN cagr >= 50 THEN 21 ELSE floor((cagr + 50) / 5) + 1 END::INTEGER AS bin, count(*)::BIGINT AS entities, {r('avg(cagr)')} AS mean_cagr FROM profile GROUP BY 1, 2")
def _(spark, sf):
    return tidy(rp.cagr_histogram(rp.growth_profile(fixed_parts(spark, sf)), -50.0, 50.0, 20), market="string", bin="int", entities="bigint", mean_cagr=6)


@query("o26_comparison", ctes("yoy", k="SELECT market, id FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY value DESC, id) AS rank FROM fixed SEMI JOIN (SELECT market, max(year) AS year FROM fixed GROUP BY 1) USING (market, year)) WHERE rank <= 5", g="SELECT * FROM yoy SEMI JOIN k USING (market, id)") + _pivot("g", "max(vp) FILTER (WHERE year = {y})", "market, id", 6))
def _(spark, sf):
    p = fixed_parts(spark, sf)
    ids = rp.top_n(latest_slice(p), ["market"], 5, [F.desc("value"), F.asc("id")])
    return tidy(rp.comparison(p, ids, YEARS), **KEY, **{str(y): 6 for y in YEARS})
