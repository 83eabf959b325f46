"""Region hierarchies."""

from pyspark.sql import functions as F

from panelloom.functions.session import cut_lineage
from panelloom.operators import regions as rg
from panelloom.plans.base import ctes, edges, mapping, query, r, tidy, trade
from panelloom.plans import q_d_shares  # noqa: F401  (closure and leaf inputs)
from panelloom.roles import DEFAULT

ONE = DEFAULT.with_(by=())
REGION_SUMS = "SELECT region AS name, year, sum(CAST(value AS DECIMAL(28,2)))::DOUBLE AS value, count(*) AS members FROM trade JOIN leaf ON leaf = name GROUP BY 1, 2"


def leaf_table(spark, sf):
    return cut_lineage(rg.leaves(edges(spark, sf)))


def named(spark, sf):
    return trade(spark, sf).groupBy("name", "year").agg(F.sum("value").alias("value"))


@query("f01_flat_regions", ctes("trade", "edges") + f"SELECT parent AS name, year, {r('sum(CAST(value AS DECIMAL(28,2)))', 2)} AS value, count(*)::BIGINT AS members, 'region' AS region_type FROM trade JOIN edges ON child = name GROUP BY 1, 2")
def _(spark, sf):
    return tidy(rg.sum_flat(named(spark, sf), edges(spark, sf), ONE), name="string", year="int", value=2, members="bigint", region_type="string")


@query("f02_hierarchy_sums", ctes("trade", "leaf", s=REGION_SUMS) + f"SELECT name, year, {r('value', 2)} AS value, members::BIGINT AS members FROM s")
def _(spark, sf):
    return tidy(rg.sum_regions(named(spark, sf), rg.leaves(edges(spark, sf)), ONE), name="string", year="int", value=2, members="bigint")


@query("f02_hierarchy_table", ctes("leaf") + """SELECT l.region, max(depth)::INTEGER AS level, coalesce((SELECT string_agg(DISTINCT parent, ', ' ORDER BY parent) FROM edges e WHERE e.child = l.region), '') AS parents,
  (SELECT count(DISTINCT child) FROM edges e WHERE e.parent = l.region)::BIGINT AS children FROM leaf l GROUP BY 1""")
def _(spark, sf):
    return tidy(rg.hierarchy(edges(spark, sf)), region="string", level="int", parents="string", children="bigint")


@query("f03_levels", ctes("leaf") + "SELECT region, max(depth)::INTEGER AS level FROM leaf GROUP BY 1")
def _(spark, sf):
    return tidy(rg.levels(edges(spark, sf)), region="string", level="int")


def shaken(spark, sf, leaf, entities):
    """Region rows with every second year off by one percent."""
    sums = rg.sum_regions(entities, leaf, ONE)
    return sums.withColumn("value", F.when(F.col("year") % 2 == 0, F.col("value") * 1.01).otherwise(F.col("value")))


@query("f04_consistency_report", ctes("trade", "leaf", s=REGION_SUMS) + f"SELECT name, year, {r('value * 1.01', 4)} AS region_value, {r('value', 4)} AS expected_value, {r('abs(value * 1.01 - value)', 3)} AS difference, members::BIGINT AS members FROM s WHERE year % 2 = 0")
def _(spark, sf):
    leaf, e = leaf_table(spark, sf), cut_lineage(named(spark, sf))
    return tidy(rg.inconsistencies(shaken(spark, sf, leaf, e), e, leaf, ONE), name="string", year="int", region_value=4, expected_value=4, difference=3, members="bigint")


@query("f05_repair_bottom_up", ctes("trade", "leaf", s=REGION_SUMS) + f"SELECT name, year, {r('value', 2)} AS value FROM s")
def _(spark, sf):
    leaf, e = leaf_table(spark, sf), cut_lineage(named(spark, sf))
    return tidy(rg.repair_bottom_up(shaken(spark, sf, leaf, e), e, leaf, ONE), name="string", year="int", value=2)


@query("f05_repair_top_down", ctes("trade", "leaf") + f"""SELECT name, year, {r('CASE WHEN year % 2 = 0 AND name IN (SELECT leaf FROM leaf WHERE region IN (SELECT r_name FROM region)) THEN value * 1.01 ELSE value END', 4)} AS value FROM trade""")
def _(spark, sf):
    from panelloom.plans.base import table
    leaf, e = leaf_table(spark, sf), cut_lineage(named(spark, sf))
    order = [x.r_name for x in table(spark, sf, "region").orderBy("r_regionkey").collect()]  # the definition's top level
    return tidy(rg.repair_top_down(shaken(spark, sf, leaf, e), e, order, leaf, ONE), name="string", year="int", value=4)


@query("f05_repair_hybrid", ctes("trade", "leaf", s=REGION_SUMS) + f"""SELECT name, year, {r("CASE WHEN year % 2 = 0 THEN value * 1.01 ELSE value END", 2)} AS value FROM s""")
def _(spark, sf):
    from panelloom.plans.base import table
    leaf, e = leaf_table(spark, sf), cut_lineage(named(spark, sf))
    order = ["Worldwide"] + [x.r_name for x in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    _, regions = rg.repair_hybrid(shaken(spark, sf, leaf, e), e, order, leaf, "Worldwide", ONE)
    return tidy(regions, name="string", year="int", value=2)


@query("f06_members_and_regions", ctes("closure") + """SELECT 'members' AS kind, descendant AS name, CAST(min(depth) AS VARCHAR) AS detail FROM closure WHERE ancestor = 'AFRICA' GROUP BY 2
  UNION ALL SELECT 'regions', descendant, string_agg(DISTINCT ancestor, ', ' ORDER BY ancestor) FROM closure GROUP BY 2""")
def _(spark, sf):
    c = cut_lineage(rg.closure(edges(spark, sf)))
    return (rg.members_of(c, "AFRICA").select(F.lit("members").alias("kind"), F.col("descendant").alias("name"), F.col("depth").cast("string").alias("detail"))
            .unionByName(rg.regions_of(c).select(F.lit("regions").alias("kind"), "name", F.col("regions").alias("detail"))))


@query("f07_cycles", "SELECT DISTINCT r_name AS region FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION SELECT n_name FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, sf):
    from panelloom.plans.base import table
    reg, nat = table(spark, sf, "region"), table(spark, sf, "nation")
    back = nat.where("n_nationkey % 2 = 0").join(reg, nat.n_regionkey == reg.r_regionkey).select(F.col("n_name").alias("parent"), F.col("r_name").alias("child"))
    return rg.cycles(edges(spark, sf).unionByName(back))


@query("f08_region_lookup", ctes("trade", "mapping") + f"SELECT t.name, year, coalesce(region, 'Others') AS region, {r('value', 2)} AS value FROM trade t LEFT JOIN mapping m ON m.name = t.name")
def _(spark, sf):
    return tidy(rg.add_region(trade(spark, sf), mapping(spark, sf)), name="string", year="int", region="string", value=2)


@query("f09_region_ids", ctes("edges") + "SELECT region, CAST(89999 + row_number() OVER (ORDER BY region) AS INTEGER) AS region_id FROM (SELECT DISTINCT parent AS region FROM edges)")
def _(spark, sf):
    return tidy(rg.region_ids(edges(spark, sf)), region="string", region_id="int")


@query("f10_top_regions", ctes("trade", "leaf", s=REGION_SUMS) + f"SELECT name, year, {r('value', 2)} AS value, row_number() OVER (PARTITION BY year ORDER BY value DESC, name)::INTEGER AS rank FROM s WHERE name <> 'Worldwide'")
def _(spark, sf):
    return tidy(rg.top_regions(rg.sum_regions(named(spark, sf), rg.leaves(edges(spark, sf)), ONE), ONE), name="string", year="int", value=2, rank="int")
