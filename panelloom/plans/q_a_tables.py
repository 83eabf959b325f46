"""Sources, reshaping, quality and scalar measures."""

from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators import quality as Q, shares as sh
from panelloom.plans.base import (INDICATORS, ctes, daily, facts, history, money, panel, part_months, parts, query, r,
                                  table, tidy, trade, world)
from panelloom.roles import DEFAULT, setting, with_setting
from panelloom.sources import readers as R

ONE = DEFAULT.with_(by=())
YEARS = list(range(1995, 2002))

# ---- A ---------------------------------------------------------------------------------------------------------------


@query("a02_standard_names", "SELECT o_custkey AS id, o_orderdate AS year, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS value FROM "
       "(SELECT o_custkey, year(o_orderdate)::INTEGER AS o_orderdate, o_totalprice FROM orders) GROUP BY 1, 2")
def _(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").alias("geo_id"), F.year("o_orderdate").alias("fiscal_year"),
                                            F.col("o_totalprice").alias("order_value"))
    named = R.standardize(raw, "panel")
    out = named.groupBy("id", "year").agg(money("value").alias("value"))
    return tidy(out, id="bigint", year="int", value=2)


@query("a04_wide_to_long", ctes("trade") + "SELECT id, name, year, round(value, 2) AS value FROM trade")
def _(spark, sf):
    wide = R.long_to_wide(trade(spark, sf), None, "sum", ONE)
    return tidy(R.wide_to_long(wide, ONE, drop_nulls=True), id="bigint", name="string", year="int", value=2)


@query("a05_long_to_wide", ctes("trade") + "SELECT id, name, " + ", ".join(
    f'round(sum(value) FILTER (WHERE year = {y}), 2) AS "{y}"' for y in YEARS) + " FROM trade GROUP BY id, name")
def _(spark, sf):
    return tidy(R.long_to_wide(trade(spark, sf), None, "sum", ONE), id="bigint", name="string", **{str(y): 2 for y in YEARS})


@query("a05_mean_by_brand", ctes("parts") + "SELECT market, " + ", ".join(
    f'CAST(sum(CAST(value AS DECIMAL(28,6))) FILTER (WHERE year = {y}) AS DOUBLE) / count(*) FILTER (WHERE year = {y}) AS "{y}"' for y in YEARS) + " FROM parts GROUP BY market")
def _(spark, sf):
    return R.long_to_wide(parts(spark, sf), None, "mean", keys=["market"])


@query("a06_lenient_numbers", "SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS year, round(o_totalprice, 2) AS value FROM orders WHERE o_orderpriority NOT LIKE '5%'")
def _(spark, sf):
    text = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").cast("string").alias("year"),
        F.when(F.col("o_orderpriority").startswith("5"), "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return tidy(R.coerce_numbers(text, {"id": "bigint", "year": "int", "value": "double"}), id="bigint", year="int", value=2)


@query("a07_type_label", ctes("panel") + """SELECT market, year, CASE WHEN year < 2000 THEN 'Historical' ELSE 'Forecast' END AS type,
  round(sum(CAST(value AS DECIMAL(28,2)))::DOUBLE, 2) AS value FROM panel GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(R.label_type(world(spark, sf), 2000), market="string", year="int", type="string", value=2)


@query("a08_previous_row_growth", ctes("world") + f"""SELECT market, year, {r('coalesce((value / nullif(lag(value) OVER (PARTITION BY market ORDER BY year), 0) - 1) * 100, 0)')}
  AS growth_rate FROM world""")
def _(spark, sf):
    return tidy(R.with_growth(world(spark, sf)), market="string", year="int", growth_rate=6)


@query("a09_indicator_union", ctes("indicators") + f"SELECT id, year, indicator, {r('value')} AS value FROM indicators")
def _(spark, sf):
    f = facts(spark, sf)
    return tidy(R.tag_indicators({i: f.select("id", "year", F.col(i).alias("value")) for i in INDICATORS}), id="bigint", year="int",
                indicator="string", value=6)


@query("a10_catalog", ctes("panel", last="SELECT market, max(year) AS y FROM panel GROUP BY 1") + """
  SELECT market, 'year' AS kind, CAST(year AS VARCHAR) AS entry FROM panel GROUP BY ALL
  UNION ALL SELECT p.market, 'latest', p.name FROM panel p JOIN last l ON l.market = p.market AND l.y = p.year
  UNION ALL SELECT '', 'entity', name FROM (SELECT DISTINCT id, name FROM panel)""")
def _(spark, sf):
    p = panel(spark, sf)
    return (R.years_of(p).select("market", F.lit("year").alias("kind"), F.col("year").cast("string").alias("entry"))
            .unionByName(R.latest_slice(p).select("market", F.lit("latest").alias("kind"), F.col("name").alias("entry")))
            .unionByName(R.entities_of(p).select(F.lit("").alias("market"), F.lit("entity").alias("kind"), F.col("name").alias("entry"))))


@query("a11_export_table", ctes("shares") + f"""SELECT market, id, year, {r('market_share')} AS market_share,
  {r('(value / nullif(lag(value) OVER (PARTITION BY market, id ORDER BY year), 0) - 1) * 100')} AS growth_rate, 'run' AS export_label FROM shares""")
def _(spark, sf):
    from panelloom.sources.sinks import export_table
    return tidy(export_table(history(spark, sf), "run"), market="string", id="bigint", year="int", market_share=6, growth_rate=6,
                export_label="string")


# ---- B ---------------------------------------------------------------------------------------------------------------

@query("b01_duplicates", "SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS distinct_rows, sum(n - 1)::BIGINT AS duplicates FROM "
       "(SELECT l_suppkey, l_shipdate, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)")
def _(spark, sf):
    return Q.duplicate_report(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity"))


@query("b01_distinct_rows", "SELECT DISTINCT o_custkey, o_orderdate FROM orders")
def _(spark, sf):
    return Q.drop_duplicates(table(spark, sf, "orders").select("o_custkey", "o_orderdate"))


@query("b02_missing_years", ctes(held="SELECT DISTINCT o_custkey AS id, year(o_orderdate)::INTEGER AS year FROM orders",
                                 span="SELECT id, min(year) AS a, max(year) AS b FROM held GROUP BY 1") +
       """SELECT id, CAST(y AS INTEGER) AS year FROM span, unnest(generate_series(a, b)) t(y)
          WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.id = span.id AND h.year = y)""")
def _(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"))
    return Q.missing_years(p, ["id"], ONE).select(F.col("id").cast("bigint").alias("id"), F.col("year").cast("int").alias("year"))


@query("b03_repeated_years", "SELECT o_custkey AS market, o_orderstatus AS type, year(o_orderdate)::INTEGER AS year, count(*)::BIGINT AS entries FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("market"), F.col("o_orderstatus").alias("type"), F.year("o_orderdate").alias("year"))
    return Q.repeated_years(p)


@query("b04_value_checks", "SELECT count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS negative, 0::BIGINT AS infinite, 0::BIGINT AS nan, count(*) FILTER (WHERE c_acctbal IS NULL)::BIGINT AS missing, "
       "0::BIGINT AS huge, 0::BIGINT AS huge_negative FROM customer")
def _(spark, sf):
    return Q.value_report(table(spark, sf, "customer"), "c_acctbal")


def _outlier_sql(low, high, repl, med=""):
    return ctes("parts", q="SELECT market, year, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, "
                           "avg(value) AS m, stddev_pop(value) AS s, count(value) AS c FROM parts GROUP BY 1, 2",
                d="SELECT market, year, quantile_cont(abs(value - med), 0.5) AS mad FROM parts JOIN q USING (market, year) GROUP BY 1, 2",
                x=f"SELECT market, id, year, value, med, {low} AS lo, {high} AS hi, c FROM parts JOIN q USING (market, year) JOIN d USING (market, year)") + f"""
      SELECT market, id, year, {r(repl)} AS value, c >= 3 AND (value < lo OR value > hi) AS was_outlier FROM x"""


def _outlier(spark, sf, **how):
    return tidy(Q.outliers(parts(spark, sf), ["market", "year"], **how), market="string", id="bigint", year="int", value=6, was_outlier="boolean")


@query("b05_outliers_iqr", _outlier_sql("q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)",
                                        "CASE WHEN c >= 3 THEN least(greatest(value, lo), hi) ELSE value END"))
def _(spark, sf):
    return _outlier(spark, sf, method="iqr", threshold=1.5, replace="clip")


@query("b05_outliers_zscore", _outlier_sql("m - 2.0 * s", "m + 2.0 * s", "CASE WHEN c >= 3 AND (value < lo OR value > hi) THEN med ELSE value END"))
def _(spark, sf):
    return _outlier(spark, sf, method="zscore", threshold=2.0, replace="median")


@query("b05_outliers_mad", _outlier_sql("med - 3.0 * mad", "med + 3.0 * mad", "CASE WHEN c >= 3 AND (value < lo OR value > hi) THEN NULL ELSE value END"))
def _(spark, sf):
    return _outlier(spark, sf, method="mad", threshold=3.0, replace="nan")


@query("b06_entity_checks", "WITH c AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_custkey END AS id, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2), "
       "e AS (SELECT id, sum(n) AS rows, count(*) FILTER (WHERE n > 1) AS rep, count(*) AS years FROM c GROUP BY 1) "
       "SELECT coalesce(sum(rows) FILTER (WHERE id IS NULL), 0)::BIGINT AS missing_ids, coalesce(sum(rep) FILTER (WHERE id IS NOT NULL), 0)::BIGINT AS repeated_entity_years, "
       "count(*) FILTER (WHERE id IS NOT NULL AND years < 3)::BIGINT AS sparse_entities FROM e")
def _(spark, sf):
    key = F.col("o_custkey")
    p = table(spark, sf, "orders").select(F.when(key % 50 != 0, key).alias("id"), F.year("o_orderdate").alias("year"))
    return Q.entity_report(p, ONE)


@query("b06_first_per_year", "SELECT o_custkey AS id, year(o_orderdate)::INTEGER AS year, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), "o_orderkey")
    return Q.first_per_year(p, [F.col("o_orderkey")], ONE)


@query("b07_hard_rules", """SELECT * FROM (SELECT unnest(['value_missing','value_negative','year_missing','year_out_of_range','id_missing','type_unknown']) AS rule,
  unnest([count(*) FILTER (WHERE l_extendedprice IS NULL), count(*) FILTER (WHERE l_extendedprice < 0), count(*) FILTER (WHERE l_shipdate IS NULL),
  count(*) FILTER (WHERE year(l_shipdate) NOT BETWEEN 1900 AND 2100), count(*) FILTER (WHERE l_suppkey IS NULL),
  count(*) FILTER (WHERE l_returnflag = 'A')])::BIGINT AS n_bad FROM lineitem)""")
def _(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") == "A", "Unknown").otherwise("Historical").alias("type"))
    return Q.rule_report(p, Q.panel_rules(ONE, with_type=True))


@query("b08_quality_score", """SELECT count(*)::BIGINT AS rows, (count(*) FILTER (WHERE v IS NULL))::BIGINT AS missing_values,
  (count(*) - count(DISTINCT (c_custkey, c_name, v)))::BIGINT AS duplicate_rows,
  (100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) > 20)::INTEGER AS issues,
  ((100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) BETWEEN 5.0000001 AND 20)::INTEGER + (count(*) FILTER (WHERE v > 9000) > 0)::INTEGER
    + (count(*) FILTER (WHERE v < 0) > 0)::INTEGER)::INTEGER AS warnings,
  (30 + CASE WHEN 100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) > 20 THEN 0 ELSE 40 END
   + CASE WHEN (100.0 * count(*) FILTER (WHERE v IS NULL) / count(*) BETWEEN 5.0000001 AND 20)::INTEGER + (count(*) FILTER (WHERE v > 9000) > 0)::INTEGER
    + (count(*) FILTER (WHERE v < 0) > 0)::INTEGER <= 2 THEN 30 ELSE 0 END)::INTEGER AS score
  FROM (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS v FROM customer)""")
def _(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("v"))
    return Q.quality_score(p, ["c_custkey", "v"], {"v": (0.0, 9000.0)}, {"c_name": 3})


@query("b09_share_totals", ctes("shares") + f"""SELECT market, year, {r('sum(market_share)')} AS share_sum, 0::BIGINT AS invalid_shares,
  count(*) FILTER (WHERE market_share > 50)::BIGINT AS dominant_shares, 'ok' AS status FROM shares GROUP BY 1, 2""")
def _(spark, sf):
    return tidy(Q.share_totals(sh.market_shares(history(spark, sf))), market="string", year="int", share_sum=6, invalid_shares="bigint",
                dominant_shares="bigint", status="string")


@query("b10_total_against_world", ctes("panel", a="SELECT market, year, sum(value) AS entity_total FROM panel GROUP BY 1, 2",
                                       b="SELECT o_orderstatus AS s, year(o_orderdate)::INTEGER AS year, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS t FROM orders GROUP BY 1, 2") + f"""
  SELECT market, a.year, {r('entity_total', 2)} AS entity_total, {r('t', 2)} AS world_total, {r('abs(entity_total - t) / t * 100')} AS deviation_pct,
  CASE WHEN abs(entity_total - t) / t * 100 > 1 THEN 'critical' WHEN abs(entity_total - t) / t * 100 > 0.1 THEN 'warning' ELSE 'ok' END AS status
  FROM a JOIN b ON a.year = b.year AND a.market = CASE s WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END""")
def _(spark, sf):
    flag = F.col("o_orderstatus")
    other = (table(spark, sf, "orders").groupBy(F.when(flag == "F", "A").when(flag == "O", "N").otherwise("R").alias("market"),
                                               F.year("o_orderdate").alias("year")).agg(money("o_totalprice").alias("value")))
    return tidy(Q.total_against_world(panel(spark, sf), other), market="string", year="int", entity_total=2, world_total=2, deviation_pct=6,
                status="string")


@query("b11_group_totals", ctes("parts") + f"""SELECT market, year, {r('sum(CAST(value AS DECIMAL(28,2)))', 2)} AS total,
  {r('abs(sum(CAST(value AS DECIMAL(28,2)))::DOUBLE - 15000000.0) / 15000000.0 * 100')} AS deviation_pct
  FROM parts GROUP BY 1, 2 HAVING abs(sum(CAST(value AS DECIMAL(28,2)))::DOUBLE - 15000000.0) / 15000000.0 * 100 > 20""")
def _(spark, sf):
    out = Q.group_total_errors(parts(spark, sf), ["market", "year"], "value", 15000000.0, 20.0)
    return tidy(out, market="string", year="int", total=2, deviation_pct=6)


@query("b12_series_checks", ctes("part_months", g="SELECT key, date, value, date - lag(date) OVER (PARTITION BY key ORDER BY date) AS gap FROM part_months") + """
  SELECT key, count(*)::BIGINT AS points, count(*) FILTER (WHERE value IS NULL)::BIGINT AS missing, 0::BIGINT AS infinite, 0::BIGINT AS repeated_dates,
  quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap, CAST(max(gap) AS DOUBLE) AS largest_gap, coalesce(var_samp(value), 0) = 0 AS constant,
  count(*) < 3 AS too_short, coalesce(max(gap) > 5 * quantile_cont(CAST(gap AS DOUBLE), 0.5), false) AS has_gap FROM g GROUP BY 1""")
def _(spark, sf):
    return Q.series_report(part_months(spark, sf))


@query("b13_series_repair", ctes("daily", x="SELECT key, date, CASE WHEN value > 700 THEN NULL ELSE value END AS value FROM daily",
                                 f="""SELECT key, date, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING),
                                   first_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x""",
                                 s="SELECT key, avg(v) AS m, stddev_samp(v) AS s FROM f GROUP BY 1") + f"""
  SELECT key, date, {r('CASE WHEN s > 0 THEN least(greatest(v, m - 3 * s), m + 3 * s) ELSE v END', 4)} AS value FROM f JOIN s USING (key)""")
def _(spark, sf):
    d = daily(spark, sf).withColumn("value", F.when(F.col("value") <= 700, F.col("value")))
    return tidy(Q.repair_series(d), key="bigint", date="date", value=4)


# ---- C ---------------------------------------------------------------------------------------------------------------

@query("c01_safe_divide", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_discount) >= 1e-10 THEN {r('l_extendedprice / l_discount', 2)} ELSE -1.0 END AS quotient FROM lineitem")
def _(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("quotient", S.safe_divide("l_extendedprice", "l_discount", default=-1.0))
    return tidy(d, l_orderkey="bigint", l_linenumber="int", l_partkey="bigint", quotient=2)


_NORM = {"s": "SELECT market, year, sum(value) AS s FROM parts GROUP BY 1, 2",
         "x": "SELECT market, id, year, value * (100.0 / s) AS x FROM parts JOIN s USING (market, year)",
         "t": "SELECT market, year, count(*) FILTER (WHERE x < 0.5) AS k, sum(x) FILTER (WHERE x >= 0.5) AS a FROM x GROUP BY 1, 2"}


@query("c02_normalize", ctes("parts", **_NORM) + f"SELECT market, id, year, {r('CASE WHEN x < 0.5 THEN 0.5 ELSE x * (1 + (100 - k * 0.5 - a) / a) END')} AS value FROM x JOIN t USING (market, year)")
def _(spark, sf):
    return tidy(sh.normalize(parts(spark, sf), ["market", "year"], "value", 100.0, 0.5), market="string", id="bigint", year="int", value=6)


_LAGGED = ctes("parts", l="SELECT market, id, year, value, lag(value) OVER (PARTITION BY market, id ORDER BY year) AS prev, year - lag(year) OVER (PARTITION BY market, id ORDER BY year) AS gap FROM parts")


def _lagged(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("market", "id").orderBy("year")
    return parts(spark, sf).select("market", "id", "year", "value", F.lag("value").over(w).alias("prev"), (F.col("year") - F.lag("year").over(w)).alias("gap"))


@query("c03_growth_rate", _LAGGED + f"""SELECT market, id, year, {r('CASE WHEN prev IS NULL THEN 0 ELSE least(greatest((value / prev - 1) * 100, -99), 500) END')} AS growth,
  {r('CASE WHEN prev IS NULL THEN 0 WHEN gap = 1 THEN least(greatest((value / prev - 1) * 100, -99), 500) ELSE least(greatest((pow(value / prev, 1.0 / gap) - 1) * 100, -99), 500) END')} AS yearly FROM l""")
def _(spark, sf):
    d = _lagged(spark, sf).withColumn("growth", S.growth_rate("value", "prev")).withColumn(
        "yearly", S.growth_rate("value", "prev", annualize=True, periods=F.col("gap").cast("double")))
    return tidy(d, market="string", id="bigint", year="int", growth=6, yearly=6)


_ENDS = ctes("parts", e="SELECT market, id, arg_min(value, year) - 60000 AS a, arg_max(value, year) - 60000 AS b, max(year) - min(year) AS n FROM parts GROUP BY 1, 2")


def _ends(spark, sf):
    return parts(spark, sf).groupBy("market", "id").agg((F.min_by("value", "year") - 60000).alias("a"), (F.max_by("value", "year") - 60000).alias("b"),
                                                        (F.max("year") - F.min("year")).cast("double").alias("n"))


@query("c04_cagr_percent", _ENDS + f"""SELECT market, id, {r('''CASE WHEN n <= 0 THEN NULL WHEN a < 0 AND b < 0 THEN -(pow(abs(b) / abs(a), 1.0 / n) - 1) * 100 WHEN a < 0 AND b > 0 THEN 200.0
  WHEN a < 0 OR b < 0 THEN -50.0 WHEN a = 0 THEN CASE WHEN b > 0 THEN 100.0 ELSE 0.0 END ELSE least(greatest((pow(b / a, 1.0 / n) - 1) * 100, -50), 200) END''')} AS cagr FROM e""")
def _(spark, sf):
    return tidy(_ends(spark, sf).withColumn("cagr", S.cagr_percent("a", "b", F.col("n"))), market="string", id="bigint", cagr=6)


@query("c05_cagr_fraction", _ENDS + f"SELECT market, id, {r('CASE WHEN n > 0 AND a > 0 AND b = 0 THEN -1.0 WHEN n > 0 AND a > 0 AND b > 0 THEN pow(b / a, 1.0 / n) - 1 END')} AS cagr FROM e")
def _(spark, sf):
    return tidy(_ends(spark, sf).withColumn("cagr", S.cagr_fraction("a", "b", F.col("n"))), market="string", id="bigint", cagr=6)


@query("c06_growth_bounds", ctes("trade", o="SELECT id, year, value, row_number() OVER (PARTITION BY id ORDER BY year) AS i FROM trade",
                                 f="""SELECT id, year, value AS v, i FROM o WHERE i = 1 UNION ALL
    SELECT o.id, o.year, CASE WHEN f.v <= 0 THEN o.value WHEN (o.value / f.v - 1) * 100 > 10 THEN f.v * 1.1 WHEN (o.value / f.v - 1) * 100 < -5 THEN f.v * (1 - 0.05) ELSE o.value END, o.i
    FROM f JOIN o ON o.id = f.id AND o.i = f.i + 1""") + f"SELECT id, year, {r('v')} AS value FROM f")
def _(spark, sf):
    from panelloom.functions.series import growth_bounds
    return tidy(growth_bounds(trade(spark, sf), ["id"], "year", "value", -5.0, 10.0), id="bigint", year="int", value=6)


@query("c07_interval", ctes("trade", h="SELECT id, year, value, row_number() OVER (PARTITION BY id ORDER BY year) AS h FROM trade") + f"""
  SELECT id, year, {r('greatest(0, value - 1.959963984540054::DOUBLE * 50000 * sqrt(h))', 2)} AS lower, {r('value + 1.959963984540054::DOUBLE * 50000 * sqrt(h)', 2)} AS upper,
  {r('value + 1.959963984540054::DOUBLE * 50000 * ln(1 + h)', 2)} AS upper_log FROM h""")
def _(spark, sf):
    from pyspark.sql import Window as W
    d = trade(spark, sf).withColumn("h", F.row_number().over(W.partitionBy("id").orderBy("year")))
    low, high = S.interval("value", "h", F.lit(50000.0))
    return tidy(d.withColumn("lower", low).withColumn("upper", high).withColumn("upper_log", S.interval("value", "h", F.lit(50000.0), method="log")[1]),
                id="bigint", year="int", lower=2, upper=2, upper_log=2)


@query("c08_currency_label", ctes("parts") + """SELECT market, id, year, CASE WHEN value = 0 THEN '$0' WHEN value >= 1e9 THEN printf('$%.2fB', value / 1e9) WHEN value >= 1e6 THEN printf('$%.2fM', value / 1e6)
  WHEN value >= 1e3 THEN printf('$%.2fK', value / 1e3) ELSE printf('$%.2f', value) END AS label FROM (SELECT market, id, year, floor(value / 100) * 100 AS value FROM parts)""")
def _(spark, sf):
    d = parts(spark, sf).withColumn("value", F.floor(F.col("value") / 100) * 100.0)
    return d.select("market", F.col("id").cast("bigint").alias("id"), F.col("year").cast("int").alias("year"), S.currency_label("value", 2).alias("label"))


# ---- files ----------------------------------------------------------------------------------------------------------

def _folder(spark) -> str:
    import uuid
    from panelloom.functions.session import run_folder
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


@query("a01_csv_scan", ctes("panel") + "SELECT market, id, year, round(value, 2) AS value FROM panel")
def _(spark, sf):
    path = _folder(spark)
    panel(spark, sf).withColumn("name", F.concat("name", F.lit(" é"))).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = R.read_csv(spark, path, "ISO-8859-1").where(F.col("name").endswith(" é"))
    return tidy(R.coerce_numbers(back, {"id": "bigint", "year": "int", "value": "double"}, strict=True), market="string", id="bigint", year="int", value=2)


@query("a01_mixed_encodings", ctes("panel") + "SELECT market, id, name || ' é' AS name, year, round(value, 2) AS value FROM panel")
def _(spark, sf):
    path, rows = _folder(spark), panel(spark, sf).withColumn("name", F.concat("name", F.lit(" é")))
    for encoding, odd in (("ISO-8859-1", 1), ("UTF-8", 0)):
        rows.where(F.col("id") % 2 == odd).write.option("header", True).option("encoding", encoding).csv(f"{path}/{odd}")
    back = R.read_csv_any(spark, [f"{path}/0", f"{path}/1"])
    return tidy(R.coerce_numbers(back, {"id": "bigint", "year": "int", "value": "double"}, strict=True), market="string", id="bigint", name="string", year="int", value=2)


@query("a03_wide_table_with_own_names", ctes("trade") + "SELECT id AS code, name AS country, year AS yr, round(value, 2) AS amount FROM trade")
def _(spark, sf):
    own = DEFAULT.with_(id="code", name="country", year="yr", value="amount", by=())
    wide = R.long_to_wide(trade(spark, sf), None, "sum", ONE).withColumnsRenamed({"id": "code", "name": "country"})
    return tidy(R.to_long(wide, own).where("amount IS NOT NULL"), code="bigint", country="string", yr="int", amount=2)


@query("a11_sink_formats", ctes("panel") + "SELECT format, market, id, year, round(value, 2) AS value FROM panel, (VALUES ('csv'), ('json'), ('wide')) f(format)")
def _(spark, sf):
    from panelloom.sources.sinks import write_panel, write_wide
    path, rows, types = _folder(spark), panel(spark, sf), {"id": "bigint", "year": "int", "value": "double"}
    write_panel(rows, f"{path}/csv", "csv")
    write_panel(rows, f"{path}/json", "json")
    write_wide(rows, f"{path}/wide", None)
    back = {"csv": R.coerce_numbers(R.read_csv(spark, f"{path}/csv"), types, strict=True), "json": R.coerce_numbers(spark.read.json(f"{path}/json"), types, strict=True),
            "wide": R.wide_to_long(R.read_parquet(spark, f"{path}/wide"), drop_nulls=True)}
    out = None
    for name, df in back.items():
        part = df.select(F.lit(name).alias("format"), "market", "id", "year", "value")
        out = part if out is None else out.unionByName(part)
    return tidy(out, format="string", market="string", id="bigint", year="int", value=2)


@query("a11_partitioned_sink", ctes("panel") + "SELECT market, id, year, round(value, 2) AS value FROM panel WHERE year = 1998")
def _(spark, sf):
    from panelloom.sources.sinks import write_panel
    path = _folder(spark)
    write_panel(panel(spark, sf), path)
    # Only the folder of the wanted year is read.
    return tidy(R.read_parquet(spark, path).where("year = 1998"), market="string", id="bigint", year="int", value=2)


# Roles named in a nested configuration, read and changed by dotted paths.
_CONFIG = {"column_mapping": {"sales": {"market": "L_RETURNFLAG", "id": "l_suppkey", "value": "l_extendedprice", "day": "l_shipdate"}}, "distribution": {"tiers": {"thresholds": [5.0, 1.0]}}}


@query("a12_column_mapping", """SELECT l_linestatus AS market, l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
  count(*) FILTER (WHERE l_extendedprice >= 5000)::BIGINT AS large FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, sf):
    config = with_setting(with_setting(_CONFIG, "column_mapping.sales.market", "l_linestatus"), "limits.value.large", 5000)
    sales = R.mapped(table(spark, sf, "lineitem"), config, "sales")
    large = F.count_if(F.col("value") >= setting(config, "limits.value.large"))
    return sales.groupBy("market", "id", F.year("day").alias("year")).agg(money("value").alias("value"), large.alias("large"))
