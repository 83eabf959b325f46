"""Trajectory harmonisation, tiers and market dynamics."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage
from panelloom.operators import dynamics as dy, forecast as fc, harmonize as hz, regions as rg, shares as sh, tiers as tr
from panelloom.sources.readers import latest_slice
from panelloom.plans.base import NEEDS, SQL, ctes, edges, history, parts, query, r, tidy, trade
from panelloom.plans import q_d_shares  # noqa: F401  (leaf input)
from panelloom.plans.q_k_forecast import yearly
from panelloom.roles import DEFAULT, HarmonizeSettings

ONE = DEFAULT.with_(by=())
LAST = 1997
IY = dict(id="bigint", year="int")
ROW = dict(market="string", **IY)
SQL["tr"] = "SELECT id, name, year, value, row_number() OVER (PARTITION BY id ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, count(*) FILTER (WHERE year <= 1997) OVER (PARTITION BY id) AS h FROM trade"
NEEDS["tr"] = ("trade",)
SQL["gro"] = "SELECT market, id, year, g FROM (SELECT market, id, year, (value / lag(value) OVER (PARTITION BY market, id ORDER BY year) - 1) * 100 AS g, row_number() OVER (PARTITION BY market, id ORDER BY year) AS i FROM parts) WHERE i > 1"
NEEDS["gro"] = ("parts",)


@query("e01_growth_table", ctes("gro") + f"SELECT market, id, year, {r('g')} AS growth_rate FROM gro")
def _(spark, sf):
    return tidy(hz.growth_table(parts(spark, sf)), **ROW, growth_rate=6)


@query("e02_forecast_start", ctes("gro", s="SELECT market, year, median(g) AS m, stddev_samp(g) AS s FROM gro GROUP BY 1, 2", l="SELECT *, lag(m) OVER w AS pm, lag(s) OVER w AS ps FROM s WINDOW w AS (PARTITION BY market ORDER BY year)",
                                   j="SELECT market, year, abs(m - pm) / (CASE WHEN pm <> 0 THEN abs(pm) ELSE 1 END) + abs(s - ps) / (CASE WHEN ps <> 0 THEN abs(ps) ELSE 1 END) AS j FROM l WHERE pm IS NOT NULL") +
       "SELECT market, CAST(arg_max(year, j) - 1 AS INTEGER) AS last_historical FROM j GROUP BY 1")
def _(spark, sf):
    return tidy(hz.forecast_start(cut_lineage(parts(spark, sf))), market="string", last_historical="int")


def _gauss(name: str, src: str, sigma: float, cond: str, offset: str, length: str) -> str:
    rad = int(4 * sigma + 0.5)
    return f"""SELECT a.id, a.year, sum(exp(-(o * o) / {2 * sigma * sigma}::DOUBLE) * b.value) / sum(exp(-(o * o) / {2 * sigma * sigma}::DOUBLE)) AS v FROM {src} a, range(-{rad}, {rad + 1}) g(o), {src} b WHERE {cond.format(t='a')} AND {cond.format(t='b')}
      AND b.id = a.id AND b.i - {offset} = CASE WHEN (((a.i - {offset} + o) % (2 * {length})) + 2 * {length}) % (2 * {length}) < {length} THEN (((a.i - {offset} + o) % (2 * {length})) + 2 * {length}) % (2 * {length})
      ELSE 2 * {length} - 1 - (((a.i - {offset} + o) % (2 * {length})) + 2 * {length}) % (2 * {length}) END GROUP BY 1, 2"""


SQL["gs"] = _gauss("gs", "tr", 1.5 * 1.3, "{t}.year > 1997", "a.h", "(a.n - a.h)").replace("b.i - a.h", "b.i - a.h")
NEEDS["gs"] = ("tr",)


# Three historical years are too few to smooth, four forecast years are enough.
@query("e03_gaussian", ctes("gs", x="SELECT tr.id, tr.year, coalesce(v, value) AS v FROM tr LEFT JOIN gs ON gs.id = tr.id AND gs.year = tr.year AND tr.n - tr.h > 3") + f"SELECT id, year, {r('v')} AS smoothed FROM x")
def _(spark, sf):
    p = hz.paths(trade(spark, sf), LAST, ONE)
    p = p.withColumn("_o", hz.smooth_gaussian(F.col("_v"), F.col("_n"), F.col("_h"), F.lit(0.5)))
    return tidy(hz.unfold(p, {"_o": "smoothed"}, ONE), **IY, smoothed=6)


@query("e04_monotone")
def _(spark, sf):
    return hz.harmonize(trade(spark, sf), LAST, HarmonizeSettings(method="monotone"), ONE)


SQL["rol"] = "SELECT id, year, i, n, h, value, greatest(0.5 * value + 0.5 * avg(value) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) AS s FROM tr"
NEEDS["rol"] = ("tr",)


@query("e05_rolling_blend", ctes("rol") + f"SELECT id, year, {r('s')} AS smoothed FROM rol")
def _(spark, sf):
    p = hz.paths(trade(spark, sf), LAST, ONE)
    p = p.withColumn("_o", hz.smooth_rolling(F.col("_v"), F.col("_n"), F.lit(0.5)))
    return tidy(hz.unfold(p, {"_o": "smoothed"}, ONE), **IY, smoothed=6)


@query("e06_adaptive")
def _(spark, sf):
    return hz.harmonize(trade(spark, sf), LAST, HarmonizeSettings(), ONE)


@query("e07_inflections", ctes("tr", d="SELECT *, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d FROM tr WINDOW w AS (PARTITION BY id ORDER BY year)", e="SELECT *, lag(d) OVER w AS a, lead(d) OVER w AS b FROM d WINDOW w AS (PARTITION BY id ORDER BY year)") +
       f"SELECT id, year, {r('(abs(d - a) + abs(b - d)) / 2 / value')} AS prominence FROM e WHERE n >= 5 AND a * d < 0 AND (abs(d - a) + abs(b - d)) / 2 / value > 0.2 * 1.4")
def _(spark, sf):
    return tidy(hz.inflections(trade(spark, sf), roles=ONE), **IY, prominence=6)


@query("e07_gradient_inflections", ctes("tr", g="SELECT *, CASE WHEN i = 0 THEN lead(value) OVER w - value WHEN i = n - 1 THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END AS g FROM tr WINDOW w AS (PARTITION BY id ORDER BY year)",
                                         s="SELECT *, CASE WHEN i = 0 THEN lead(g) OVER w - g WHEN i = n - 1 THEN g - lag(g) OVER w ELSE (lead(g) OVER w - lag(g) OVER w) / 2 END AS s FROM g WINDOW w AS (PARTITION BY id ORDER BY year)", z="SELECT *, lead(s) OVER (PARTITION BY id ORDER BY year) AS nx FROM s") +
       "SELECT id, year, CASE WHEN s < 0 AND nx > 0 THEN 'deceleration' ELSE 'acceleration' END AS kind FROM z WHERE n >= 5 AND nx IS NOT NULL AND (s < 0) <> (nx < 0)")
def _(spark, sf):
    return tidy(hz.gradient_inflections(trade(spark, sf), ONE), **IY, kind="string")


SQL["tra"] = """SELECT id, year, i, n, h, value, CASE WHEN year BETWEEN 1996 AND 1999 THEN (1 - (year - 1996) / 4.0::DOUBLE) * value + (year - 1996) / 4.0::DOUBLE * s WHEN year <= 1997 THEN value ELSE s END AS s FROM rol"""
NEEDS["tra"] = ("rol",)


@query("e08_transition", ctes("tra") + f"SELECT id, year, {r('s')} AS harmonized FROM tra")
def _(spark, sf):
    return tidy(hz.harmonize(trade(spark, sf), LAST, HarmonizeSettings(method="rolling"), ONE), **IY, harmonized=6)


SQL["cnv"] = """SELECT id, year, i, n, h, s FROM tra WHERE i <= h UNION ALL SELECT b.id, b.year, b.i, b.n, b.h, CASE WHEN a.s > 0 THEN greatest(0, 1 - 2 * (b.i - b.h) / (b.n - b.h - 1)::DOUBLE) * b.s + (1 - greatest(0, 1 - 2 * (b.i - b.h) / (b.n - b.h - 1)::DOUBLE)) * 1.15 * a.s ELSE b.s END
  FROM cnv a JOIN tra b ON b.id = a.id AND b.i = a.i + 1 AND a.i >= b.h"""
NEEDS["cnv"] = ("tra",)


@query("e09_convergence", ctes("cnv") + f"SELECT id, year, {r('s')} AS harmonized FROM cnv")
def _(spark, sf):
    p = hz.paths(trade(spark, sf), LAST, ONE)
    v, y, n, h = (F.col(c) for c in ("_v", "_y", "_n", "_h"))
    p = p.withColumn("_s", hz.transition(hz.smooth_rolling(v, n, F.lit(0.5)), v, y, h, LAST, HarmonizeSettings()))
    return tidy(hz.unfold(p.withColumn("_o", hz.converge(F.col("_s"), n, h, F.lit(15.0))), {"_o": "harmonized"}, ONE), **IY, harmonized=6)


def _with_world(spark, sf):
    t = cut_lineage(trade(spark, sf)).select("name", "year", "value")
    w = t.groupBy("year").agg((F.sum("value") * 1.02).alias("value")).withColumn("name", F.lit("Worldwide"))
    return t.withColumn("region_type", F.lit("entity")).unionByName(w.withColumn("region_type", F.lit("region")))


@query("e10_match_world", ctes("trade") + f"SELECT name, year, {r('value * 1.02', 3)} AS value FROM trade UNION ALL SELECT 'Worldwide', year, {r('sum(CAST(value AS DECIMAL(28,2)))::DOUBLE * 1.02', 3)} FROM trade GROUP BY 2")
def _(spark, sf):
    return tidy(hz.match_world(_with_world(spark, sf), roles=ONE), name="string", year="int", value=3)


@query("e11_refresh_regions", ctes("trade", "leaf") + f"SELECT name, year, {r('value', 2)} AS value FROM trade UNION ALL SELECT 'Worldwide', year, {r('sum(CAST(value AS DECIMAL(28,2)))', 2)} FROM trade GROUP BY 2")
def _(spark, sf):
    return tidy(hz.refresh_regions(_with_world(spark, sf), rg.leaves(edges(spark, sf)), ONE), name="string", year="int", value=2)


@query("e12_harmonize_all")
def _(spark, sf):
    d = cut_lineage(trade(spark, sf))
    out = hz.harmonize(d, LAST, HarmonizeSettings(), ONE).select("id", "year", F.col("harmonized").alias("value"))
    named = out.join(d.select("id", "name").distinct(), "id").select("name", "year", "value").withColumn("region_type", F.lit("entity"))
    world = d.groupBy("year").agg(F.sum("value").alias("value")).withColumn("name", F.lit("Worldwide")).withColumn("region_type", F.lit("region"))
    return hz.match_world(named.unionByName(world), roles=ONE)


# ---- tiers -----------------------------------------------------------------------------------------------------------

TIER = "CASE WHEN {0} >= 2 THEN 1 WHEN {0} >= 1 THEN 2 WHEN {0} >= 0.5 THEN 3 ELSE 4 END"


def _latest(spark, sf):
    d = latest_slice(dy.features(history(spark, sf)))
    return d.withColumn("tier", sh.tier_of("market_share", (2.0, 1.0, 0.5)))


SQL["feats"] = """SELECT market, id, year, value, market_share, g, coalesce(g, 0) AS growth_rate, CASE WHEN n > 2 THEN coalesce(stddev_samp(g) OVER (PARTITION BY market, id ORDER BY year ROWS 2 PRECEDING), 0) ELSE 0 END AS volatility, n FROM (
  SELECT *, (value / lag(value) OVER (PARTITION BY market, id ORDER BY year) - 1) * 100 AS g, count(*) OVER (PARTITION BY market, id) AS n FROM shares)"""
NEEDS["feats"] = ("shares",)
SQL["latest"] = f"SELECT *, {TIER.format('market_share')} AS tier FROM feats SEMI JOIN now USING (market, id, year)"
NEEDS["latest"] = ("feats", "now")


@query("d07_automatic_tiers")
def _(spark, sf):
    return tr.share_tiers(sh.market_shares(history(spark, sf)))[1]


# Least error of the first j distinct shares in k tiers, with the cuts; then the silhouette of each market's partitions.
_DP = dict(c="SELECT market, CAST(round(market_share / 1e-4) AS BIGINT) AS u, count(*) AS n FROM now GROUP BY ALL",
           px="SELECT market, row_number() OVER w AS j, u, n, sum(n) OVER w AS cn, sum(n * u::DOUBLE) OVER w AS cs, sum(n * u::DOUBLE * u) OVER w AS cq FROM c WINDOW w AS (PARTITION BY market ORDER BY u)",
           p0="SELECT market, j, cn, cs, cq FROM px UNION ALL SELECT DISTINCT market, 0, 0, 0, 0 FROM px",
           co="SELECT a.market, a.j AS i, b.j, greatest(b.cq - a.cq - (b.cs - a.cs) ** 2 / (b.cn - a.cn), 0)::DOUBLE AS v FROM p0 a JOIN p0 b ON a.market = b.market AND a.j < b.j",
           d1="SELECT market, j, v, [0::BIGINT, j] AS cuts FROM co WHERE i = 0",
           **{f"d{k}": f"SELECT d.market, co.j, min(d.v + co.v) AS v, arg_min(list_append(d.cuts, co.j), d.v + co.v) AS cuts FROM d{k - 1} d JOIN co ON co.market = d.market AND co.i = d.j GROUP BY 1, 2" for k in range(2, 9)},
           mx="SELECT market, max(j) AS m FROM px GROUP BY 1",
           pt=" UNION ALL ".join(f"SELECT market, {k}::INTEGER AS k, v, cuts FROM d{k} JOIN mx USING (market) WHERE j = m" + (" AND m < 3" if k == 1 else "") for k in (1, *range(3, 9))),
           cl="SELECT market, k, v, k - t.i + 1 AS tier, cuts[t.i] AS lo, cuts[t.i + 1] AS hi FROM pt, range(1, 9) t(i) WHERE t.i <= k",
           cm="SELECT cl.*, b.cn - a.cn AS n, b.cs - a.cs AS s, b.cq - a.cq AS q FROM cl JOIN p0 a ON a.market = cl.market AND a.j = cl.lo JOIN p0 b ON b.market = cl.market AND b.j = cl.hi",
           ds="SELECT px.market, px.j, px.n AS w, cm.k, cm.n, j > lo AND j <= hi AS own, greatest(cm.n * px.u::DOUBLE * px.u - 2 * px.u * cm.s + cm.q, 0) AS d FROM px JOIN cm USING (market)",
           ab="SELECT market, k, j, max(w) AS w, max(n) FILTER (WHERE own) AS n, max(d / greatest(n - 1, 1)) FILTER (WHERE own) AS a, min(d / n) FILTER (WHERE NOT own) AS b FROM ds GROUP BY 1, 2, 3",
           sl="SELECT market, k, sum(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END * w) / sum(w) AS sil FROM ab WHERE k > 1 GROUP BY 1, 2")


@query("g02_exact_partitions", ctes("now", **_DP) + f"SELECT market, k, {r('v * 1e-8', 5)} AS error, {r('sil', 5)} AS silhouette FROM pt LEFT JOIN sl USING (market, k)")
def _(spark, sf):
    return tidy(tr.exact_partitions(latest_slice(sh.market_shares(history(spark, sf)))), market="string", k="int", error=5, silhouette=5)


@query("d07_exact_tiers", ctes("now", **_DP, bk="SELECT market, arg_max(k, coalesce(sil, -2) - k * 1e-12) AS k FROM pt LEFT JOIN sl USING (market, k) GROUP BY 1",
                               e="SELECT cm.market, cm.k, cm.tier, cm.n, a.u * 1e-4 AS low, b.u * 1e-4 AS high FROM cm JOIN bk USING (market, k) JOIN px a ON a.market = cm.market AND a.j = lo + 1 JOIN px b ON b.market = cm.market AND b.j = hi") +
       f"""SELECT market, k, CAST(tier AS INTEGER) AS tier, {r('low', 4)} AS low, {r('high', 4)} AS high, n::BIGINT AS entities,
  {r('CASE WHEN tier = 1 THEN low WHEN tier = k THEN greatest(low * 0.3, 0.01) ELSE sqrt(low * lead(high) OVER (PARTITION BY market ORDER BY tier)) END', 5)} AS threshold FROM e""")
def _(spark, sf):
    return tidy(tr.exact_tiers(latest_slice(sh.market_shares(history(spark, sf)))), market="string", k="int", tier="int", low=4, high=4, entities="bigint", threshold=5)


@query("g01_cluster_tiers")
def _(spark, sf):
    d = cut_lineage(_latest(spark, sf).drop("tier"))
    model, numbering = tr.fit(d, ["market_share", "growth_rate", "volatility"], 4, weights={"market_share": 2.0}, dimensions=2)
    return tr.predict(model, numbering, d).groupBy("tier").agg(F.count(F.lit(1)).alias("entities"), F.avg("market_share").alias("mean_share"))


@query("g02_choose_k")
def _(spark, sf):
    return tr.choose_k(_latest(spark, sf), ["market_share", "growth_rate"], range(3, 9))[1]


@query("g03_feature_importance", ctes("latest", u="SELECT tier, feature, v FROM (UNPIVOT (SELECT tier, market_share::DOUBLE AS market_share, growth_rate::DOUBLE AS growth_rate FROM latest) ON market_share, growth_rate INTO NAME feature VALUE v)",
                                       b="SELECT feature, tier, least(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 10), 9) AS b FROM u WINDOW w AS (PARTITION BY feature)",
                                       c="SELECT feature, tier, b, count(*)::DOUBLE AS c FROM b GROUP BY 1, 2, 3", p="SELECT *, sum(c) OVER (PARTITION BY feature) AS t, sum(c) OVER (PARTITION BY feature, tier) AS pt, sum(c) OVER (PARTITION BY feature, b) AS pb FROM c") +
       f"SELECT feature, {r('sum(c / t * ln(c * t / (pt * pb))) / -sum(c / t * ln(pb / t))')} AS importance FROM p GROUP BY 1")
def _(spark, sf):
    return tidy(tr.importance(_latest(spark, sf), ["market_share", "growth_rate"]), feature="string", importance=6)


@query("g04_tier_profile", ctes("latest") + "\nUNION ALL ".join(f"SELECT '{f}' AS feature, tier, {r(f'min({f})')} AS low, {r(f'avg({f})')} AS mean, {r(f'max({f})')} AS high, count(*)::BIGINT AS entities FROM latest GROUP BY 2" for f in ("market_share", "growth_rate", "volatility")))
def _(spark, sf):
    return tidy(tr.profile(_latest(spark, sf), ["market_share", "growth_rate", "volatility"]), feature="string", tier="int", low=6, mean=6, high=6, entities="bigint")


@query("g05_score_new_rows")
def _(spark, sf):
    f = cut_lineage(dy.features(history(spark, sf)))
    model, numbering = tr.fit(f.join(latest_slice(f).select("market", "id", (F.col("year") - 2).alias("year")), ["market", "id", "year"], "left_semi"), ["market_share", "growth_rate"], 3)
    return tr.predict(model, numbering, latest_slice(f)).select("market", "id", "year", "tier")


@query("g06_tier_transitions", ctes("parts", s="SELECT market, id, year, value / sum(value) OVER (PARTITION BY market, year) * 100 AS s FROM parts", t="SELECT *, " + TIER.format("s") + " AS tier FROM s",
                                    l="SELECT tier AS a, CASE WHEN lead(year) OVER w = year + 1 THEN lead(tier) OVER w END AS b FROM t WINDOW w AS (PARTITION BY market, id ORDER BY year)") +
       f"SELECT a AS from_tier, b AS to_tier, count(*)::BIGINT AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a)')} AS probability FROM l WHERE b IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    d = sh.market_shares(parts(spark, sf)).withColumn("tier", sh.tier_of("market_share", (2.0, 1.0, 0.5)))
    return tidy(tr.transition_matrix(d), from_tier="int", to_tier="int", n="bigint", probability=6)


# ---- dynamics -------------------------------------------------------------------------------------------------------

@query("g07_features", ctes("feats") + f"SELECT market, id, year, {r('growth_rate')} AS growth_rate, {r('market_share')} AS market_share FROM feats")
def _(spark, sf):
    return tidy(dy.features(history(spark, sf)), **ROW, growth_rate=6, market_share=6)


@query("g08_volatility", ctes("feats") + f"SELECT market, id, year, {r('volatility')} AS volatility FROM feats")
def _(spark, sf):
    return tidy(dy.features(history(spark, sf)), **ROW, volatility=6)


SQL["phs"] = """SELECT *, row_number() OVER (PARTITION BY market, id ORDER BY year) AS i, CASE WHEN n < 3 THEN 'insufficient_data' WHEN growth_rate > 30 AND market_share < 5 THEN 'introduction' WHEN growth_rate > 15 THEN 'growth' WHEN growth_rate > -5 AND volatility > 15 THEN 'disruption'
  WHEN growth_rate > -5 THEN 'maturity' WHEN volatility > 20 THEN 'disruption' ELSE 'decline' END AS ph FROM feats"""
NEEDS["phs"] = ("feats",)


@query("g09_phases", ctes("phs") + "SELECT market, id, year, ph AS market_phase FROM phs")
def _(spark, sf):
    return tidy(dy.phases(history(spark, sf)), **ROW, market_phase="string")


_ALLOW = " OR ".join(f"(own = '{k}' AND common IN ({', '.join(repr(x) for x in v)}))" for k, v in dy.FOLLOWERS.items())
SQL["phn"] = "SELECT market, id, year, i, ph, growth_rate, value, lead(ph) OVER (PARTITION BY market, id ORDER BY year) AS nx FROM phs"
NEEDS["phn"] = ("phs",)
SQL["sph"] = f"""SELECT market, id, year, i, ph AS p, growth_rate AS g FROM phn WHERE i = 1 UNION ALL SELECT market, id, year, i, CASE WHEN common <> own AND ({_ALLOW}) THEN common ELSE own END, g FROM (
  SELECT b.market, b.id, b.year, b.i, b.ph AS own, b.growth_rate AS g, CASE WHEN b.ph = b.nx THEN b.ph ELSE a.p END AS common FROM sph a JOIN phn b ON b.market = a.market AND b.id = a.id AND b.i = a.i + 1)"""
NEEDS["sph"] = ("phn",)


@query("g10_phase_smoothing", ctes("sph") + "SELECT market, id, year, p AS smoothed_phase FROM sph")
def _(spark, sf):
    return tidy(dy.smooth_phases(dy.phases(history(spark, sf))), **ROW, smoothed_phase="string")


_LO = "CASE ph " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in dy.PHASES.items()) + " END"
_HI = "CASE ph " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in dy.PHASES.items()) + " END"


@query("g11_clamp_growth", ctes("phs", l=f"SELECT market, id, {_LO}::DOUBLE AS lo, {_HI}::DOUBLE AS hi FROM (SELECT market, id, arg_max(ph, year) AS ph FROM phs GROUP BY 1, 2)",
                                x="SELECT p.market, p.id, p.year, p.i, p.value, p.g, lo, hi FROM phs p JOIN l USING (market, id)",
                                f="SELECT market, id, year, i, value AS v, g AS gh FROM x WHERE i = 1 UNION ALL SELECT b.market, b.id, b.year, b.i, CASE WHEN b.year > 1998 AND b.lo IS NOT NULL THEN a.v * (1 + least(greatest(b.g, b.lo), b.hi) / 100) ELSE b.value END, CASE WHEN b.year > 1998 AND b.lo IS NOT NULL THEN least(greatest(b.g, b.lo), b.hi) ELSE b.g END FROM f a JOIN x b ON b.market = a.market AND b.id = a.id AND b.i = a.i + 1") +
       f"SELECT market, id, year, {r('v')} AS value, {r('gh')} AS growth_held FROM f")
def _(spark, sf):
    return tidy(dy.clamp_growth(dy.phases(history(spark, sf)), 1998), **ROW, value=6, growth_held=6)


@query("g12_best_curve")
def _(spark, sf):
    return dy.best_curve(dy.curve_fits(cut_lineage(yearly(spark, sf))))


@query("g13_curve_projection")
def _(spark, sf):
    s = cut_lineage(yearly(spark, sf))
    return dy.project(s, dy.best_curve(dy.curve_fits(s)), 3)


@query("g14_next_phase", ctes("phs", l="SELECT market, id, arg_max(ph, year) AS c, arg_max(growth_rate, year) AS g FROM phs GROUP BY 1, 2", n="SELECT l.market, l.id, c, l.g, count(*) AS n FROM l JOIN phs p ON p.market = l.market AND p.id = l.id AND p.ph = l.c GROUP BY 1, 2, 3, 4",
                              b="SELECT * FROM (VALUES ('introduction', 1, 3), ('growth', 3, 7), ('maturity', 5, 15), ('decline', 3, 10), ('disruption', 1, 3), ('insufficient_data', 0, 999)) b(c, lo, hi)") + """
  SELECT market, id, c AS current, n::BIGINT AS years_in_phase, CASE WHEN n >= hi THEN CASE c WHEN 'introduction' THEN 'growth' WHEN 'growth' THEN 'maturity' WHEN 'maturity' THEN 'decline' ELSE c END
  WHEN n >= lo THEN CASE WHEN c = 'introduction' AND g > 30 THEN 'growth' WHEN c = 'growth' AND g < 15 THEN 'maturity' WHEN c = 'maturity' AND g < 0 THEN 'decline' ELSE c END ELSE c END AS next FROM n JOIN b USING (c)""")
def _(spark, sf):
    return tidy(dy.next_phase(cut_lineage(dy.phases(history(spark, sf))), F.col("growth_rate")), market="string", id="bigint", current="string", years_in_phase="bigint", next="string")


@query("g15_dynamics")
def _(spark, sf):
    rep = dy.analyze(cut_lineage(history(spark, sf)))
    return rep["rows"].groupBy("market", "smoothed_phase").agg(F.count(F.lit(1)).alias("rows"), F.avg("growth_rate").alias("mean_growth"))


@query("g16_curve_formulas", ctes("tr") + f"""SELECT id, year, {r('value * (1 - exp(-0.43 * i)) / (1 + 0.4 / 0.03 * exp(-0.43 * i))', 4)} AS bass, {r('value * exp(-2.0 * exp(-0.5 * i))', 4)} AS gompertz, {r('value / (1 + exp(-0.8 * (i - 3.0)))', 4)} AS logistic FROM tr""")
def _(spark, sf):
    d = fc.indexed(trade(spark, sf).withColumnRenamed("id", "key").withColumn("date", F.col("year")))
    t, v = F.col("t"), F.col("value")
    return tidy(d.withColumnRenamed("key", "id").withColumn("bass", fc.bass(t, v, F.lit(0.03), F.lit(0.4))).withColumn("gompertz", fc.gompertz(t, v, F.lit(2.0), F.lit(0.5)))
                .withColumn("logistic", fc.logistic(t, v, F.lit(3.0), F.lit(0.8))), **IY, bass=4, gompertz=4, logistic=4)
