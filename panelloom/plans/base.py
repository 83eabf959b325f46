"""Query registry and the inputs every registered query derives from the given tables.

Each input exists twice: as a Spark job and as the SQL text of the same table for the cross-check. Money is summed as
decimal on both sides, so the order of summation cannot change a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelloom.functions import scalars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c) -> Column:
    return F.sum(S.col(c).cast("decimal(18,2)")).cast("double")


def tidy(df: DataFrame, **columns) -> DataFrame:
    """Select and round for comparison: an int is the number of decimals, a string a type to cast to."""
    out = []
    for name, how in columns.items():
        c = F.col(name)
        out.append((F.round(c.cast("double"), how) + F.lit(0.0)).alias(name) if isinstance(how, int) else c.cast(how).alias(name))
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def ctes(*names: str, **extra: str) -> str:
    """``WITH RECURSIVE`` prefix holding the named inputs (in order, with what they need) and extra CTE bodies."""
    wanted: list[str] = []

    def need(n):
        for d in NEEDS.get(n, ()):
            need(d)
        if n not in wanted:
            wanted.append(n)
    for n in names:
        need(n)
    bodies = {**{n: SQL[n] for n in wanted}, **extra}
    # A step used twice is computed once; a recursive step (it names itself) cannot be marked so.
    parts = [f"{n} AS {'' if re.search(rf'(FROM|JOIN) {n}' + chr(92) + 'b', b) else 'MATERIALIZED '}({b})" for n, b in bodies.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}

# ---- yearly panel: market = return flag, entity = supplier ------------------------------------------------------------

SQL["panel"] = """
  SELECT p.market, p.id, s.s_name AS name, p.year, p.value FROM (
    SELECT l_returnflag AS market, l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM lineitem GROUP BY 1, 2, 3) p JOIN supplier s ON s.s_suppkey = p.id"""


def panel(spark, sf) -> DataFrame:
    """(market, id, name, year, value). Line items are summed before the name join, so only the sums are shuffled."""
    sums = (table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("market"), F.col("l_suppkey").alias("id"),
                          F.year("l_shipdate").alias("year")).agg(money("l_extendedprice").alias("value")))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sums.join(names, "id").select("market", "id", "name", "year", "value")


# Every row of the tables counts, the part year at the end included.
SQL["history"] = "SELECT * FROM panel"
NEEDS["history"] = ("panel",)


def history(spark, sf) -> DataFrame:
    return panel(spark, sf)


SQL["world"] = "SELECT market, year, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS value FROM history GROUP BY 1, 2"
NEEDS["world"] = ("history",)


def world(spark, sf) -> DataFrame:
    """Total per market and year."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("market"), F.year("l_shipdate").alias("year"))
            .agg(money("l_extendedprice").alias("value")))


# ---- wide panel of parts inside brands: many entities per market ---------------------------------------------------------

SQL["parts"] = """
  SELECT p_brand AS market, l_partkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3"""


def parts(spark, sf) -> DataFrame:
    sums = (table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.year("l_shipdate").alias("year"))
            .agg(money("l_extendedprice").alias("value")))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("market"))
    return sums.join(brands, "id").select("market", "id", "year", "value")


# ---- one-market supplier panel -----------------------------------------------------------------------------------------

SQL["trade"] = """
  SELECT p.id, s.s_name AS name, p.year, p.value FROM (
    SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM lineitem GROUP BY 1, 2) p JOIN supplier s ON s.s_suppkey = p.id"""


def trade(spark, sf) -> DataFrame:
    sums = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"))
            .agg(money("l_extendedprice").alias("value")))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sums.join(names, "id").select("id", "name", "year", "value")


# ---- monthly series per supplier and per part ---------------------------------------------------------------------------

SQL["monthly"] = """
  SELECT l_suppkey AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2"""


def monthly(spark, sf, key: str = "l_suppkey") -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(F.col(key).alias("key"), F.trunc("l_shipdate", "month").alias("date"))
            .agg(money("l_extendedprice").alias("value")))


SQL["part_months"] = SQL["monthly"].replace("l_suppkey", "l_partkey")


def part_months(spark, sf) -> DataFrame:
    return monthly(spark, sf, "l_partkey")


SQL["daily"] = """
  SELECT user_id AS key, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2"""


def daily(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("date"))
            .agg(money("value").alias("value")))


# ---- indicators -----------------------------------------------------------------------------------------------------------

SQL["facts"] = """
  SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS market_value,
         CAST(count(*) AS DOUBLE) AS lines,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS discount,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS quantity,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS returned
  FROM lineitem GROUP BY 1, 2"""


def facts(spark, sf) -> DataFrame:
    """One row per supplier-year: the market value and four indicator columns from the same scan."""
    n = F.count(F.lit(1)).cast("double")
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year"))
            .agg(money("l_extendedprice").alias("market_value"), n.alias("lines"),
                 (money("l_discount") / n).alias("discount"), (money("l_quantity") / n).alias("quantity"),
                 (F.count_if(F.col("l_returnflag") == "R") / n).alias("returned")))


INDICATORS = ("lines", "discount", "quantity", "returned")
SQL["indicators"] = " UNION ALL ".join(
    f"SELECT id, year, market_value, '{i}' AS indicator, {i} AS value FROM facts" for i in INDICATORS)
NEEDS["indicators"] = ("facts",)


def indicators(spark, sf) -> DataFrame:
    """Long form (id, year, market_value, indicator, value)."""
    return facts(spark, sf).unpivot(["id", "year", "market_value"], list(INDICATORS), "indicator", "value")


# ---- region edges: Worldwide > region > nation > supplier, plus an overlapping trade group --------------------------------

SQL["edges"] = """
  SELECT 'Worldwide' AS parent, r_name AS child FROM region
  UNION ALL SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'Trade group', r_name FROM region WHERE r_regionkey < 2
  UNION ALL SELECT 'Trade group', n_name FROM nation WHERE n_regionkey = 0"""


def edges(spark, sf) -> DataFrame:
    reg, nat, sup = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    pair = lambda a, b: [a.alias("parent"), b.alias("child")]
    group = F.lit("Trade group")
    return (reg.select(*pair(F.lit("Worldwide"), F.col("r_name")))
            .unionByName(nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(*pair(F.col("r_name"), F.col("n_name"))))
            .unionByName(sup.join(nat, sup.s_nationkey == nat.n_nationkey).select(*pair(F.col("n_name"), F.col("s_name"))))
            .unionByName(reg.where("r_regionkey < 2").select(*pair(group, F.col("r_name"))))
            .unionByName(nat.where("n_regionkey = 0").select(*pair(group, F.col("n_name")))))


# name of the nation (as region) a supplier belongs to; nation keys divisible by 5 stay unassigned on purpose
SQL["mapping"] = """
  SELECT s_name AS name, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 4"""


def mapping(spark, sf) -> DataFrame:
    reg, nat, sup = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
            .where(F.col("n_regionkey") != 4).select(F.col("s_name").alias("name"), F.col("r_name").alias("region")))


# ---- shares, used by many queries ------------------------------------------------------------------------------------------

SQL["totals"] = "SELECT market, year, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS total FROM history GROUP BY 1, 2"
NEEDS["totals"] = ("history",)
SQL["shares"] = """
  SELECT h.market, h.id, h.name, h.year, h.value, h.value / t.total * 100 AS market_share
  FROM history h JOIN totals t USING (market, year)"""
NEEDS["shares"] = ("totals",)
# the shares of each market's own last year
SQL["now"] = "SELECT s.* FROM shares s JOIN (SELECT market, max(year) AS year FROM shares GROUP BY 1) USING (market, year)"
NEEDS["now"] = ("shares",)

# ---- forecasts against actuals: naive growth and flat forecasts of each year ------------------------------------------

SQL["scored"] = """
  SELECT a.market, a.id, a.year, m.model, a.value AS actual,
         CASE m.model WHEN 'flat' THEN b.value ELSE b.value * 1.1 END AS forecast,
         CAST(a.year - 1995 AS INTEGER) AS horizon
  FROM history a JOIN history b ON a.market = b.market AND a.id = b.id AND b.year = a.year - 1
  CROSS JOIN (VALUES ('flat'), ('plus10')) m(model)"""
NEEDS["scored"] = ("history",)


def scored(spark, sf) -> DataFrame:
    """(market, id, year, model, actual, forecast, horizon) from last year's value, flat and plus ten percent."""
    w = W.partitionBy("market", "id").orderBy("year")
    h = history(spark, sf).select("market", "id", "year", "value", F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("value").over(w)).alias("last"))
    models = F.array(F.struct(F.lit("flat").alias("model"), F.lit(1.0).alias("factor")),
                     F.struct(F.lit("plus10").alias("model"), F.lit(1.1).alias("factor")))
    return (h.where("last is not null").select("*", F.inline(models))
            .select("market", "id", "year", "model", F.col("value").alias("actual"),
                    (F.col("last") * F.col("factor")).alias("forecast"), (F.col("year") - 1995).alias("horizon")))


# ---- scenario table: key-hashed shocks on the latest year's shares -------------------------------------------------------

DRAWS = 40
SQL["uniform"] = "SELECT 1"


def sql_uniform(*parts: str) -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


SQL["scenarios"] = f"""
  SELECT market, id, year, CAST(s AS BIGINT) AS scenario_id, value * (0.8 + 0.4 * {sql_uniform('market', 'id', 's')}) AS value
  FROM history, range(1, {DRAWS + 1}) t(s)"""
NEEDS["scenarios"] = ("history",)


def scenarios(spark, sf) -> DataFrame:
    """(market, id, year, scenario_id, value): caller-supplied draws, here from a key hash, for every year."""
    return (history(spark, sf)
            .withColumn("scenario_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(DRAWS).cast("bigint"))))
            .select("market", "id", "year", "scenario_id",
                    (F.col("value") * (0.8 + 0.4 * S.key_uniform("market", "id", "scenario_id"))).alias("value")))
