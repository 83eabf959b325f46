"""Reporting tables: concentration, growth profiles, contributions, ranks, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import order, scalars as S
from panelloom.functions.session import with_row
from panelloom.operators import shares as sh
from panelloom.operators.regions import add_region
from panelloom.roles import DEFAULT, Roles


def _entity_window(roles: Roles):
    return W.partitionBy(*roles.entity).orderBy(roles.year)


def _change(c: str | Column, w) -> Column:
    """Change in % against the previous row, null without one or from zero."""
    c = S.col(c)
    return (F.try_divide(c, F.lag(c).over(w)) - 1) * 100


def top_n(df: DataFrame, group: list[str], n: int, by: list[Column], out: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The rank filter is applied before the shuffle too, so a group of any size stays cheap."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*by))).where(F.col(out) <= n)


def concentration(df: DataFrame, group: list[str], value: str = "value", id_col: str = "id") -> DataFrame:
    """HHI, CR4, CR8, Gini and entropy per group, all 0 where the total is not positive.

    The Gini ranks come from exact distributed positions; everything else is a plain aggregate.
    """
    v = F.col(value)
    totals = df.groupBy(*group).agg(F.sum(v).alias("_t"), F.count(v).alias("entities"))
    share = F.try_divide(v, F.col("_t"))
    sums = df.join(totals, group).groupBy(*group).agg(
        F.max("entities").alias("entities"), F.max("_t").alias("_t"), (F.sum(share * share) * 10000).alias("hhi"),
        (-F.sum(share * F.log2(share + 1e-10))).alias("entropy"))
    top = (top_n(df, group, 8, [F.desc(value), F.asc(id_col)]).groupBy(*group)
           .agg(F.sum(F.when(F.col("rank") <= 4, v)).alias("_c4"), F.sum(v).alias("_c8")))
    ranked = order.positions(df, group, v).groupBy(*group).agg(
        F.sum(F.col("_key") * F.col("_n") * (F.col("_below") + (F.col("_n") + 1) / 2)).alias("_ranked"))
    n = F.col("entities")
    positive = F.col("_t") > 0

    def or_zero(c):
        return F.when(positive, c).otherwise(F.lit(0.0))

    return (sums.join(top, group).join(ranked, group)
            .select(*group, "entities", or_zero(F.col("hhi")).alias("hhi"), or_zero(F.try_divide("_c4", "_t") * 100).alias("cr4"),
                    or_zero(F.try_divide("_c8", "_t") * 100).alias("cr8"),
                    or_zero(F.try_divide(2 * F.col("_ranked"), n * F.col("_t")) - (n + 1) / n).alias("gini"),
                    or_zero(F.col("entropy")).alias("entropy")))


def concentration_level(hhi: Column | str) -> Column:
    return S.bands(hhi, [(2500.0, "High"), (1500.0, "Moderate")], "Low", strict=True)


def growth_profile(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per entity with at least two years: compound, mean, spread and slope of yearly growth, and growth of the share."""
    y, v = roles.year, roles.value
    w = _entity_window(roles)
    rows = sh.market_shares(df, roles, "zero")
    rows = rows.withColumn("_g", F.when(F.lag(v).over(w) > 0, _change(v, w)))
    rows = rows.withColumn("_i", F.count("_g").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    span = (F.col("_y1") - F.col("_y0")).cast("double")
    agg = rows.groupBy(*roles.entity).agg(
        F.count(F.lit(1)).alias("years"), F.min(y).alias("_y0"), F.max(y).alias("_y1"), F.min_by(v, y).alias("initial_value"),
        F.max_by(v, y).alias("latest_value"), F.avg("_g").alias("_m"), F.stddev_pop("_g").alias("_s"), F.count("_g").alias("_n"),
        F.regr_slope("_g", F.when(F.col("_g").isNotNull(), F.col("_i"))).alias("_a"),
        F.min_by(sh.SHARE, y).alias("_s0"), F.max_by(sh.SHARE, y).alias("latest_share"))
    both = (F.col("initial_value") > 0) & (F.col("latest_value") > 0)
    return agg.where("years >= 2").select(
        *roles.entity, "years", "initial_value", "latest_value", "latest_share",
        F.coalesce(F.when(both, S.cagr_fraction("initial_value", "latest_value", span) * 100), F.lit(0.0)).alias("cagr"),
        F.coalesce("_m", F.lit(0.0)).alias("mean_growth"), F.coalesce("_s", F.lit(0.0)).alias("volatility"),
        F.when(F.col("_n") > 2, F.col("_a")).otherwise(F.lit(0.0)).alias("acceleration"),
        F.coalesce(F.when((F.col("_s0") > 0) & (span > 0), (F.pow(F.try_divide("latest_share", "_s0"), F.try_divide(F.lit(1.0), span)) - 1) * 100),
                   F.lit(0.0)).alias("share_growth"))


def yearly_changes(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Adds absolute and % change of value and share against the previous year held."""
    w = _entity_window(roles)
    out = df.withColumn("value_change", F.col(roles.value) - F.lag(roles.value).over(w)).withColumn("value_change_pct", _change(roles.value, w))
    if sh.SHARE in df.columns:
        out = out.withColumn("share_change", F.col(sh.SHARE) - F.lag(sh.SHARE).over(w)).withColumn("share_change_pct", _change(sh.SHARE, w))
    return out


def growth_by_join(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Growth against exactly the calendar year before (rows without it are left out)."""
    past = df.select(*roles.entity, (F.col(roles.year) + 1).alias(roles.year), F.col(roles.value).alias("previous"))
    return (df.join(past, [*roles.entity, roles.year]).where("previous > 0")
            .withColumn("growth_rate", (F.try_divide(F.col(roles.value), F.col("previous")) - 1) * 100))


def cagr_between(df: DataFrame, start: int, end: int, roles: Roles = DEFAULT) -> DataFrame:
    v = roles.value
    a = df.where(F.col(roles.year) == start).select(*roles.entity, F.col(v).alias("start_value"))
    b = df.where(F.col(roles.year) == end).select(*roles.entity, F.col(v).alias("end_value"))
    return (a.join(b, roles.entity).where("start_value > 0")
            .withColumn("cagr", S.cagr_fraction("start_value", "end_value", F.lit(float(end - start))) * 100))


def cagr_windows(df: DataFrame, spans: tuple[int, ...] = (3, 5, 7), roles: Roles = DEFAULT) -> DataFrame:
    """Compound growth over the last ``span`` years of each entity for every span that its history covers."""
    y, v = roles.year, roles.value
    last = df.groupBy(*roles.entity).agg(F.max(y).alias("_y"), F.max_by(v, y).alias("end_value"))
    wanted = last.withColumn("span", F.explode(F.array(*[F.lit(s) for s in spans]))).withColumn(y, F.col("_y") - F.col("span"))
    base = df.select(*roles.entity, y, F.col(v).alias("start_value"))
    return (wanted.join(base, [*roles.entity, y]).where("start_value > 0")
            .select(*roles.entity, "span", (S.cagr_fraction("start_value", "end_value", F.col("span").cast("double")) * 100).alias("cagr")))


def movers(df: DataFrame, year: int, n: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    """The ``n`` largest gains and losses in % of one year per market."""
    rows = yearly_changes(df, roles).where((F.col(roles.year) == year) & F.col("value_change_pct").isNotNull())
    keys = list(roles.by)
    up = top_n(rows, keys, n, [F.desc("value_change_pct"), F.asc(roles.id)]).withColumn("side", F.lit("gain"))
    down = top_n(rows, keys, n, [F.asc("value_change_pct"), F.asc(roles.id)]).withColumn("side", F.lit("loss"))
    return up.unionByName(down).select(*roles.entity, "side", "rank", "value_change_pct")


def growth_consistency(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Mean, spread and share of positive years of value and share growth."""
    rows = yearly_changes(sh.market_shares(df, roles), roles)
    out = []
    for kind in ("value", "share"):
        g = F.col(f"{kind}_change_pct")
        out += [F.coalesce(F.avg(g), F.lit(0.0)).alias(f"mean_{kind}_growth"), F.coalesce(F.stddev_samp(g), F.lit(0.0)).alias(f"{kind}_volatility"),
                (F.try_divide(F.count_if(g > 0), F.count(g)) * 100).alias(f"positive_{kind}_years")]
    return rows.groupBy(*roles.entity).agg(*out, F.count("value_change_pct").alias("_n")).where("_n > 0").drop("_n")


def market_statistics(df: DataFrame, top: int = 5, roles: Roles = DEFAULT) -> DataFrame:
    """One row per market and leading entity: first and last total, multiple, compound growth, the entity's last value and share."""
    y, v = roles.year, roles.value
    totals = df.groupBy(*roles.period).agg(F.sum(v).alias("_t")).groupBy(*roles.by).agg(
        F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.min_by("_t", y).alias("first_total"), F.max_by("_t", y).alias("last_total"))
    span = (F.col("last_year") - F.col("first_year")).cast("double")
    totals = (totals.withColumn("multiple", F.coalesce(F.try_divide("last_total", "first_total"), F.lit(0.0)))
              .withColumn("total_cagr", F.coalesce(S.cagr_fraction("first_total", "last_total", span) * 100, F.lit(0.0))))
    joined = df.join(totals, list(roles.by)) if roles.by else df.transform(with_row, totals)
    leaders = top_n(joined.where(F.col(y) == F.col("last_year")), list(roles.by), top, [F.desc(v), F.asc(roles.id)])
    first = joined.where(F.col(y) == F.col("first_year")).select(*roles.entity, F.col(v).alias("_first"))
    return (leaders.join(first, roles.entity, "left")
            .select(*roles.by, "first_year", "last_year", "first_total", "last_total", "multiple", "total_cagr", "rank", roles.id,
                    F.col(v).alias("final_value"), (F.try_divide(F.col(v), F.col("last_total")) * 100).alias("final_share"),
                    (S.cagr_fraction("_first", v, span) * 100).alias("cagr")))


def top_per_year(df: DataFrame, n: int, roles: Roles = DEFAULT) -> DataFrame:
    return top_n(df, roles.period, n, [F.desc(roles.value), F.asc(roles.id)])


def history_of_leaders(df: DataFrame, n: int, roles: Roles = DEFAULT) -> DataFrame:
    """All years of the entities that lead their market's latest year."""
    last = df.groupBy(*roles.by).agg(F.max(roles.year).alias(roles.year))
    latest = df.join(last if roles.by else F.broadcast(last), roles.period, "left_semi")
    leaders = top_n(latest, list(roles.by), n, [F.desc(roles.value), F.asc(roles.id)]).select(*roles.entity)
    return df.join(leaders, roles.entity, "left_semi")


def share_evolution(df: DataFrame, n: int = 10, roles: Roles = DEFAULT) -> DataFrame:
    """Share per year of the ``n`` entities with the highest mean share."""
    shared = sh.market_shares(df, roles)
    means = shared.groupBy(*roles.entity).agg(F.avg(sh.SHARE).alias("mean_share"))
    leaders = top_n(means, list(roles.by), n, [F.desc("mean_share"), F.asc(roles.id)])
    return shared.join(leaders, roles.entity)


def positioning(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Quadrant of each entity's last row by the market's median size and median growth."""
    rows = yearly_changes(df, roles).where(F.col("value_change_pct").isNotNull())
    last = rows.groupBy(*roles.entity).agg(F.max_by(roles.value, roles.year).alias("size"), F.max_by("value_change_pct", roles.year).alias("growth"))
    keys = list(roles.by)
    mid = order.quantiles(last, keys, "size", {"median_size": 0.5}).join(order.quantiles(last, keys, "growth", {"median_growth": 0.5}), keys)
    big, fast = F.col("size") >= F.col("median_size"), F.col("growth") >= F.col("median_growth")
    return last.join(mid, keys).withColumn("quadrant", F.when(big & fast, "leader").when(big, "established").when(fast, "challenger").otherwise("niche"))


def risk_return(profile: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Quadrant of (cagr, volatility) by the market means, with the low and high volatility classes."""
    means = profile.groupBy(*roles.by).agg(F.avg("cagr").alias("mean_return"), F.avg("volatility").alias("mean_risk"))
    joined = profile.join(means, list(roles.by)) if roles.by else profile.transform(with_row, means)
    gain, risky = F.col("cagr") >= F.col("mean_return"), F.col("volatility") >= F.col("mean_risk")
    return (joined.withColumn("quadrant", F.when(gain & ~risky, "star").when(gain, "growth").when(~risky, "stable").otherwise("risk"))
            .withColumn("volatility_class", F.when(F.col("volatility") < F.col("mean_risk") * 0.5, "low")
                        .when(F.col("volatility") > F.col("mean_risk") * 1.5, "high").otherwise("middle")))


def waterfall(df: DataFrame, first: int, last: int, n: int = 10, roles: Roles = DEFAULT) -> DataFrame:
    """Contribution of the leading entities of ``last`` to the change of the total, with the running level."""
    v, keys = roles.value, list(roles.by)
    a = df.where(F.col(roles.year) == first).groupBy(*roles.entity).agg(F.sum(v).alias("first_value"))
    b = df.where(F.col(roles.year) == last).groupBy(*roles.entity).agg(F.sum(v).alias("last_value"))
    both = (a.join(b, roles.entity, "full").withColumn("first_value", F.coalesce("first_value", F.lit(0.0)))
            .withColumn("last_value", F.coalesce("last_value", F.lit(0.0))))
    totals = both.groupBy(*keys).agg(F.sum("first_value").alias("first_total"), F.sum("last_value").alias("last_total"))
    leaders = top_n(both, keys, n, [F.desc("last_value"), F.asc(roles.id)]).withColumn("contribution", F.col("last_value") - F.col("first_value"))
    joined = leaders.join(totals, keys) if keys else leaders.transform(with_row, totals)
    running = F.sum("contribution").over(W.partitionBy(*keys).orderBy("rank"))
    return joined.withColumn("level", F.col("first_total") + running)


def region_summary(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per market and region: total, mean, count, deviation, share and variation coefficient."""
    v = F.col(roles.value)
    sums = df.groupBy(*roles.by, "region").agg(F.sum(v).alias("total"), F.avg(v).alias("average"), F.count(v).alias("entries"), F.stddev_samp(v).alias("deviation"))
    whole = W.partitionBy(*roles.by)  # regions are few: the summary is already aggregated
    return (sums.withColumn("market_share", F.try_divide("total", F.sum("total").over(whole)) * 100)
            .withColumn("variation", F.try_divide("deviation", "average") * 100))


def region_metrics(summary: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    s = F.col("market_share") / 100
    return (summary.groupBy(*roles.by).agg(F.max_by("region", F.struct("total", "region")).alias("dominant_region"), F.count(F.lit(1)).alias("regions"),
                                           (F.sum(s * s) * 10000).alias("hhi"), F.max("market_share").alias("top_share"),
                                           F.avg("variation").alias("mean_variation"))
            .withColumn("level", concentration_level("hhi")))


def region_growth(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    sums = df.groupBy(*roles.by, "region", roles.year).agg(F.sum(roles.value).alias(roles.value))
    w = W.partitionBy(*roles.by, "region").orderBy(roles.year)
    return sums.withColumn("growth_rate", _change(roles.value, w))


def region_radar(df: DataFrame, metrics: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Region means of each metric brought to 0..100 between the lowest and highest region (50 where they agree)."""
    means = df.groupBy(*roles.by, "region").agg(*[F.avg(m).alias(m) for m in metrics])
    whole = W.partitionBy(*roles.by)
    out = means
    for m in metrics:
        low, high = F.min(m).over(whole), F.max(m).over(whole)
        out = out.withColumn(f"{m}_index", F.when(high > low, (F.col(m) - low) / (high - low) * 100).otherwise(F.lit(50.0)))
    return out.select(*roles.by, "region", *[f"{m}_index" for m in metrics])


def yearly_ranks(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rank per market-year by value, equal values share the best rank, over groups of any size."""
    return order.with_ranks(df, roles.period, -F.col(roles.value), rank="rank")


def executive(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Per market-year: total, growth of the total, and shares held by the first 1, 3, 5 and 10 entities."""
    v = F.col(roles.value)
    top = top_n(df, roles.period, 10, [F.desc(roles.value), F.asc(roles.id)]).groupBy(*roles.period).agg(
        *[F.sum(F.when(F.col("rank") <= k, v)).alias(f"_t{k}") for k in (1, 3, 5, 10)])
    totals = df.groupBy(*roles.period).agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("entities"))
    w = W.partitionBy(*roles.by).orderBy(roles.year)
    return (totals.join(top, roles.period)
            .select(*roles.period, "total", "entities", (F.try_divide(F.col("total"), F.lag("total").over(w)) * 100 - 100).alias("growth_rate"),
                    *[(F.try_divide(f"_t{k}", "total") * 100).alias(f"top{k}_share") for k in (1, 3, 5, 10)]))


def subtotals(df: DataFrame, group: str = "region", roles: Roles = DEFAULT) -> DataFrame:
    """Totals by group and year with subtotals per group and overall."""
    return (df.rollup(group, roles.year).agg(F.sum(roles.value).alias("total"), F.count(F.lit(1)).alias("entries"),
                                             F.grouping_id().alias("level")))


def table_view(df: DataFrame, years: tuple[int, int], ids: list | None = None, limit: int | None = None, roles: Roles = DEFAULT) -> DataFrame:
    out = df.where(F.col(roles.year).between(*years))
    if ids is not None:
        out = out.where(F.col(roles.id).isin(ids))
    out = out.orderBy(F.desc(roles.year), F.desc(roles.value), F.asc(roles.id))
    return out.limit(limit) if limit is not None else out


def share_table(df: DataFrame, year: int, n: int, rest: str = "Others", roles: Roles = DEFAULT) -> DataFrame:
    """Shares of one year: the ``n`` largest by name, everything else folded into one row."""
    rows = df.where(F.col(roles.year) == year)
    v, keys = F.col(roles.value), list(roles.by)
    top = top_n(rows, keys, n, [F.desc(roles.value), F.asc(roles.id)]).select(*keys, F.col(roles.name).alias("label"), v.alias("value"))
    totals = rows.groupBy(*keys).agg(F.sum(v).alias("_total"), F.count(F.lit(1)).alias("_k"))
    held = top.groupBy(*keys).agg(F.sum("value").alias("_top"))
    tail = (totals.join(held, keys).where(F.col("_k") > n)
            .select(*keys, F.lit(rest).alias("label"), (F.col("_total") - F.col("_top")).alias("value")))
    return (top.unionByName(tail).join(totals.drop("_k"), keys)
            .select(*keys, "label", "value", (F.try_divide("value", "_total") * 100).alias("market_share")))


def market_insights(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(market, rule, fired, value) from the latest year: leader share, top three, small entities, growth of the total."""
    ex = executive(df, roles)
    last = ex.groupBy(*roles.by).agg(F.max_by(F.struct("total", "entities", "growth_rate", "top1_share", "top3_share"), roles.year).alias("e"), F.max(roles.year).alias("_y"))
    side = last.select(*roles.by, F.col("_y").alias(roles.year), F.col("e.total").alias("_t"))
    small = (df.join(side, roles.period).groupBy(*roles.by).agg(
        F.try_divide(F.count_if(F.col(roles.value) < F.col("_t") * 0.01), F.count(F.lit(1))).alias("small")))
    e = F.col("e")
    rules = [("leader_dominates", e["top1_share"] > 50, e["top1_share"]), ("leader_leads", (e["top1_share"] > 30) & (e["top1_share"] <= 50), e["top1_share"]),
             ("top_three_concentrated", e["top3_share"] > 80, e["top3_share"]), ("healthy_competition", e["top3_share"] < 50, e["top3_share"]),
             ("many_small_entities", F.col("small") > 0.5, F.col("small") * 100), ("total_grew", F.coalesce(e["growth_rate"] > 0, F.lit(False)), e["growth_rate"])]
    return (last.join(small, list(roles.by))
            .select(*roles.by, F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), f.alias("fired"), x.alias("value")) for n, f, x in rules]))))


def region_insights(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """(market, rule, fired, value) for the regional rules; growth looks at the last two years."""
    m = region_metrics(region_summary(df, roles), roles)
    growth = region_growth(df, roles)
    last = growth.groupBy(*roles.by, "region").agg(F.max_by("growth_rate", roles.year).alias("_g")).groupBy(*roles.by).agg(F.count_if(F.col("_g") > 10).alias("growing"))
    n = F.col("regions")
    rules = [("dominant_region", F.lit(True), F.col("top_share")), ("high_concentration", F.col("level") == "High", F.col("hhi")),
             ("well_distributed", F.col("level") == "Low", F.col("hhi")), ("global_presence", n >= 4, n.cast("double")),
             ("multi_region", n == 3, n.cast("double")), ("focused", n < 3, n.cast("double")),
             ("uneven", F.col("mean_variation") > 100, F.col("mean_variation")), ("even", F.col("mean_variation") < 50, F.col("mean_variation")),
             ("growing_regions", F.col("growing") > 0, F.col("growing").cast("double"))]
    return (m.join(last, list(roles.by))
            .select(*roles.by, F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), f.alias("fired"), x.alias("value")) for r, f, x in rules]))))


def bubbles(df: DataFrame, n: int, roles: Roles = DEFAULT) -> DataFrame:
    """Size and growth per year of the latest year's leaders."""
    return yearly_changes(history_of_leaders(df, n, roles), roles).where(F.col("value_change_pct").isNotNull())


def region_totals(df: DataFrame, mapping: DataFrame, unassigned: str = "Others", roles: Roles = DEFAULT) -> DataFrame:
    """Total per region and year with what no region covers as its own row."""
    named = df.groupBy(*roles.by, roles.name, roles.year).agg(F.sum(roles.value).alias(roles.value))
    return (add_region(named, mapping, unassigned, roles).groupBy(*roles.by, "region", roles.year)
            .agg(F.sum(roles.value).alias("total")).withColumn("assigned", F.col("region") != unassigned))


def report_sheet(df: DataFrame, years: list[int], kind: str, roles: Roles = DEFAULT) -> DataFrame:
    """Years as columns: ``size`` by entity, ``growth`` by entity, ``region`` totals."""
    y = roles.year
    if kind == "size":
        return df.groupBy(*roles.entity, roles.name).pivot(y, years).agg(F.sum(roles.value))
    if kind == "growth":
        return yearly_changes(df, roles).groupBy(*roles.entity, roles.name).pivot(y, years).agg(F.first("value_change_pct"))
    return df.groupBy(*roles.by, "region").pivot(y, years).agg(F.sum(roles.value))


def size_view(df: DataFrame, years: list[int], roles: Roles = DEFAULT) -> DataFrame:
    """Entity by year sums with 0 where an entity has no row."""
    wide = df.groupBy(*roles.entity).pivot(roles.year, years).agg(F.sum(roles.value))
    return wide.fillna(0.0, subset=[str(x) for x in years])


def cagr_histogram(profile: DataFrame, low: float, high: float, bins: int, roles: Roles = DEFAULT) -> DataFrame:
    bucket = F.width_bucket("cagr", F.lit(low), F.lit(high), F.lit(bins))
    return profile.groupBy(*roles.by, bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("entities"), F.avg("cagr").alias("mean_cagr"))


def comparison(df: DataFrame, ids: DataFrame, years: list[int], roles: Roles = DEFAULT) -> DataFrame:
    """Yearly growth of the chosen entities, years as columns."""
    chosen = df.join(ids.select(*roles.entity).distinct(), roles.entity, "left_semi")
    return yearly_changes(chosen, roles).groupBy(*roles.entity).pivot(roles.year, years).agg(F.first("value_change_pct"))


