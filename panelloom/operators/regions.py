"""Region hierarchies as edge tables: closure, roll-up, consistency and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelloom.functions.session import cut_lineage
from panelloom.roles import DEFAULT, Roles

FIRST_REGION_ID = 90_000
# Fragments that mark a row for the whole world.
WORLD_TERMS = ("world", "global", "total", "worldwide")


def define(spark: SparkSession, regions: dict[str, list[str] | dict]) -> DataFrame:
    """Edges (parent, child, region_id, position) from a flat or nested definition, ids in order of definition."""
    rows: list[tuple[str, str, int, int]] = []
    ids: dict[str, int] = {}

    def walk(name: str, inside) -> None:
        ids.setdefault(name, FIRST_REGION_ID + len(ids))
        for position, child in enumerate(inside):
            label = child if isinstance(child, str) else next(iter(child))
            rows.append((name, label, ids[name], position))
            nested = inside[child] if isinstance(inside, dict) else (child[label] if isinstance(child, dict) else None)
            if nested:
                walk(label, nested)

    for name, inside in regions.items():
        walk(name, inside)
    return spark.createDataFrame(rows, "parent string, child string, region_id int, position int")


def region_ids(edges: DataFrame) -> DataFrame:
    """(region, region_id): numbered from 90000 in name order. Regions are a definition table, not data."""
    names = edges.select(F.col("parent").alias("region")).distinct()
    return names.withColumn("region_id", F.lit(FIRST_REGION_ID - 1) + F.row_number().over(W.orderBy("region")))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) for every path length; loops over levels only, each one a join, however deep they go.

    A name that comes up below itself is a cycle, which would go on for ever: it raises.
    """
    pairs = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    frontier = cut_lineage(pairs.withColumn("depth", F.lit(1)))
    step = edges.select(F.col("parent").alias("descendant"), F.col("child").alias("_next")).distinct()
    levels, depth = frontier, 1
    while frontier.where("ancestor = descendant").isEmpty():
        depth += 1
        frontier = (frontier.join(step, "descendant").select("ancestor", F.col("_next").alias("descendant"))
                    .distinct().withColumn("depth", F.lit(depth)))
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            return levels
        levels = levels.unionByName(frontier)
    raise ValueError("region definitions hold a cycle")


def leaves(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(region, leaf, depth): each leaf once per region, at its shortest path."""
    closed = closure(edges) if closed is None else closed
    inner = edges.select(F.col("parent").alias("descendant")).distinct()
    return (closed.join(inner, "descendant", "left_anti").groupBy(F.col("ancestor").alias("region"), F.col("descendant").alias("leaf"))
            .agg(F.min("depth").alias("depth")))


def levels(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(region, level): the longest of the shortest ways down to a leaf."""
    return leaves(edges, closed).groupBy("region").agg(F.max("depth").alias("level"))


def cycles(edges: DataFrame) -> DataFrame:
    """Names that reach themselves, however long the way.

    First whatever has no parent or no child left is taken off, again and again: it lies on no cycle, and an edge list without cycles
    is empty after that. Among the rest the known ways are joined with themselves, which doubles their length each time, until no new
    pair comes up.
    """
    left = cut_lineage(edges.select("parent", "child").distinct())
    size, before = left.count(), -1
    while size not in (0, before):
        inner = left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        left = cut_lineage(inner.join(inner.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child"))
        size, before = left.count(), size
    pairs, known, before = left.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")), size, -1
    while known != before:
        further = pairs.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("_next"))
        pairs = cut_lineage(pairs.join(further, "descendant").select("ancestor", F.col("_next").alias("descendant")).unionByName(pairs).distinct())
        known, before = pairs.count(), known
    return pairs.where("ancestor = descendant").select(F.col("ancestor").alias("region")).distinct()


def sum_flat(df: DataFrame, edges: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """One level: per region and market-year the sum of its direct members that occur as rows."""
    side = edges.select(F.col("parent").alias("region"), F.col("child").alias(roles.name)).distinct()
    return (df.join(side, roles.name).groupBy(*roles.by, F.col("region").alias("_region"), roles.year)
            .agg(F.sum(roles.value).alias(roles.value), F.count(F.lit(1)).alias("members"))
            .withColumnRenamed("_region", roles.name).withColumn("region_type", F.lit("region")))


def sum_regions(df: DataFrame, leaf_table: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Any depth: every leaf counts once per region. Values are summed per entity name first, so the join with the
    leaf table multiplies one row per (entity, year), not raw rows."""
    side = leaf_table.select("region", F.col("leaf").alias(roles.name))
    return (df.groupBy(*roles.by, roles.name, roles.year).agg(F.sum(roles.value).alias(roles.value))
            .join(side, roles.name).groupBy(*roles.by, "region", roles.year)
            .agg(F.sum(roles.value).alias(roles.value), F.count(F.lit(1)).alias("members"))
            .withColumnRenamed("region", roles.name).withColumn("region_type", F.lit("region")))


def hierarchy(edges: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(region, level, parents, children): names joined in order. Definition-sized."""
    up = edges.groupBy(F.col("child").alias("region")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ", ").alias("parents"))
    down = (edges.groupBy(F.col("parent").alias("region"))
            .agg(F.countDistinct("child").alias("children")))
    return (levels(edges, closed).join(up, "region", "left").join(down, "region")
            .select("region", "level", F.coalesce("parents", F.lit("")).alias("parents"), "children"))


def _tolerance(a, b):
    size = F.greatest(a, b)
    return F.when(size > 1000, size * 0.0001).otherwise(F.lit(0.01))


def inconsistencies(regions: DataFrame, entities: DataFrame, leaf_table: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Region rows whose value is off the sum of their leaves by more than 0.01 (0.01 % above 1000)."""
    expected = sum_regions(entities, leaf_table, roles).select(*roles.period, roles.name, F.col(roles.value).alias("expected_value"), "members")
    a, b = F.col("region_value"), F.col("expected_value")
    return (regions.select(*roles.period, roles.name, F.col(roles.value).alias("region_value"))
            .join(expected, [*roles.period, roles.name]).withColumn("difference", F.abs(a - b))
            .where(F.col("difference") > _tolerance(a, b)))


def repair_bottom_up(regions: DataFrame, entities: DataFrame, leaf_table: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Region rows set to the sum of their leaves where they disagree."""
    expected = sum_regions(entities, leaf_table, roles).select(*roles.period, roles.name, F.col(roles.value).alias("_e"))
    off = F.abs(F.col(roles.value) - F.col("_e")) > _tolerance(F.col(roles.value), F.col("_e"))
    return (regions.join(expected, [*roles.period, roles.name], "left")
            .withColumn(roles.value, F.when(off, F.col("_e")).otherwise(F.col(roles.value))).drop("_e"))


def repair_waves(region_order: list[str], leaf_table: DataFrame) -> DataFrame:
    """(region, wave): regions in the same wave share no leaf, and a region comes after every earlier one with which it shares a leaf.

    The pairs of regions that share a leaf are found from the leaf table; they and the waves have the size of the region definitions.
    """
    spark = leaf_table.sparkSession
    place = spark.createDataFrame([(n, k) for k, n in enumerate(dict.fromkeys(reversed(region_order)))] or [("", 0)], "region string, back int")  # a name given twice counts at its last place
    known = leaf_table.select("region", "leaf").distinct().join(F.broadcast(place), "region")
    pairs = (known.select("leaf", F.col("back").alias("a")).join(known.select("leaf", F.col("back").alias("b")), "leaf").where("a > b").select("a", "b").distinct().collect())
    order = list(dict.fromkeys(reversed(region_order)))
    wave = [0] * len(order)
    earlier: dict[int, list[int]] = {}
    for a, b in pairs:
        earlier.setdefault(b, []).append(a)
    for b in reversed(range(len(order))):
        wave[b] = 1 + max((wave[a] for a in earlier.get(b, ())), default=-1)
    return spark.createDataFrame(list(zip(order, wave)), "region string, wave int")


def repair_top_down(regions: DataFrame, entities: DataFrame, region_order: list[str], leaf_table: DataFrame,
                    roles: Roles = DEFAULT) -> DataFrame:
    """Entity values scaled so that each named region's leaves add up to the region row; equal parts where they sum to 0.

    Regions are taken in the order given (a later one overrules an earlier one on shared leaves). Those that share no leaf do not touch each other's sums, so they are
    repaired together: the entities are written once for each wave (``repair_waves``), at most as often as regions overlap each other, however many there are.
    """
    if not region_order:
        return entities
    waves = cut_lineage(repair_waves(region_order, leaf_table))
    out = entities
    for wave in range(waves.agg(F.max("wave")).first()[0] + 1):
        own = waves.where(F.col("wave") == wave).select("region")
        members = leaf_table.join(F.broadcast(own), "region", "left_semi").select(F.col("leaf").alias(roles.name), F.col("region").alias("_region")).distinct()
        target = regions.select(*roles.period, F.col(roles.name).alias("_region"), F.col(roles.value).alias("_t")).join(F.broadcast(own.withColumnRenamed("region", "_region")), "_region", "left_semi")
        marked = out.join(members, roles.name, "left")
        group = [*roles.period, "_region"]
        sums = marked.where("_region IS NOT NULL").groupBy(*group).agg(F.sum(roles.value).alias("_s"), F.count(F.lit(1)).alias("_k")).join(target, group)
        v = F.col(roles.value)
        off = F.abs(F.col("_t") - F.col("_s")) > _tolerance(F.col("_t"), F.col("_s"))
        new = F.when(off & (F.col("_s") == 0), F.col("_t") / F.col("_k")).when(off, v * F.try_divide(F.col("_t"), F.col("_s"))).otherwise(v)
        # Rows and their totals both read the step before, so each step is written out once.
        out = cut_lineage(marked.join(sums, group, "left").withColumn(roles.value, new).select(*entities.columns))
    return out


def repair_hybrid(regions: DataFrame, entities: DataFrame, region_order: list[str], leaf_table: DataFrame,
                  top: str = "Worldwide", roles: Roles = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Entities follow every region but ``top``; then ``top`` follows the entities. Returns (entities, regions)."""
    moved = repair_top_down(regions, entities, [x for x in region_order if x != top], leaf_table, roles)
    world = repair_bottom_up(regions.where(F.col(roles.name) == top), moved, leaf_table, roles)
    return moved, regions.where(F.col(roles.name) != top).unionByName(world)


def members_of(closed: DataFrame, region: str) -> DataFrame:
    return closed.where(F.col("ancestor") == region).groupBy("descendant").agg(F.min("depth").alias("depth"))


def regions_of(closed: DataFrame) -> DataFrame:
    """(name, regions): all regions above each name."""
    return (closed.select(F.col("descendant").alias("name"), "ancestor").distinct().groupBy("name")
            .agg(F.array_join(F.array_sort(F.collect_list("ancestor")), ", ").alias("regions"), F.count(F.lit(1)).alias("n_regions")))


def add_region(df: DataFrame, mapping: DataFrame, default: str = "Others", roles: Roles = DEFAULT) -> DataFrame:
    side = mapping.select(F.col("name").alias(roles.name), "region")
    return df.join(side, roles.name, "left").withColumn("region", F.coalesce("region", F.lit(default)))


def top_regions(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Region rows without those for the whole world, ranked by value within a market-year (regions are few)."""
    lowered = F.lower(roles.name)
    world = F.exists(F.array(*[F.lit(t) for t in WORLD_TERMS]), lambda t: F.contains(lowered, t))
    w = W.partitionBy(*roles.period).orderBy(F.desc(roles.value), F.asc(roles.name))
    return df.where((F.col("region_type") == "region") & ~world).withColumn("rank", F.row_number().over(w))
