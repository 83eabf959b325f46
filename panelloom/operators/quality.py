"""Data-quality checks. Each check is one aggregate pass; repairs keep every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import order, scalars as S
from panelloom.functions.session import with_row
from panelloom.roles import DEFAULT, Roles

HUGE = 1e15
ALLOWED_TYPES = ("Historical", "Forecast", "Projection")


def duplicate_report(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicates) over whole rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def year_spine(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Every year between first and last per key."""
    span = df.groupBy(*keys).agg(F.min(roles.year).alias("_a"), F.max(roles.year).alias("_b")).where("_a is not null")
    return span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(roles.year))


def missing_years(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Gaps per key (no keys: the whole table)."""
    held = df.select(*keys, roles.year).distinct()
    return year_spine(held, keys, roles).join(held, [*keys, roles.year], "left_anti")


def repeated_years(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return (df.groupBy(*roles.by, roles.type, roles.year).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1"))


def value_report(df: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    infinite = F.abs(v) == float("inf")
    return df.agg(F.count_if(v < 0).alias("negative"), F.count_if(infinite).alias("infinite"),
                  F.count_if(F.isnan(v)).alias("nan"), F.count_if(v.isNull()).alias("missing"),
                  F.count_if((v > HUGE) & ~infinite).alias("huge"), F.count_if((v < -HUGE) & ~infinite).alias("huge_negative"))


def infinite_to_null(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, S.finite(value))


def outliers(df: DataFrame, keys: list[str], value: str = "value", method: str = "iqr", threshold: float = 3.0,
             replace: str = "clip") -> DataFrame:
    """Clip, replace by the median, or null values outside the band of their group (groups of three values or more).

    Quartiles come from exact positions, not from a per-group value list, so a group may be any size.
    """
    v = F.col(value)
    if method == "iqr":
        stats = order.quantiles(df, keys, v, {"_q1": 0.25, "_med": 0.5, "_q3": 0.75})
        spread = (F.col("_q3") - F.col("_q1")) * threshold
        low, high = F.col("_q1") - spread, F.col("_q3") + spread
    elif method == "zscore":
        stats = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
        if replace == "median":
            stats = _join(stats, order.quantiles(df, keys, v, {"_med": 0.5}), keys, "left")
        low, high = F.col("_m") - threshold * F.col("_s"), F.col("_m") + threshold * F.col("_s")
    elif method == "mad":
        middle = order.quantiles(df, keys, v, {"_med": 0.5})
        off = _join(df, middle, keys, "left").withColumn("_off", F.abs(v - F.col("_med")))
        stats = _join(middle, order.quantiles(off, keys, F.col("_off"), {"_mad": 0.5}), keys, "left")
        low, high = F.col("_med") - threshold * F.col("_mad"), F.col("_med") + threshold * F.col("_mad")
    else:
        raise ValueError(f"unknown method {method}")
    stats = _join(stats, df.groupBy(*keys).agg(F.count(v).alias("_c")), keys, "left")
    joined = _join(df, stats.withColumn("_low", low).withColumn("_high", high), keys, "left")
    outside = (F.col("_c") >= 3) & ((v < F.col("_low")) | (v > F.col("_high")))
    new = {"clip": F.least(F.greatest(v, F.col("_low")), F.col("_high")), "nan": F.lit(None).cast("double"),
           "median": F.col("_med") if replace == "median" else None}[replace]
    return joined.select(*[c for c in df.columns if c != value], F.when(outside, new).otherwise(v).alias(value),
                         F.coalesce(outside, F.lit(False)).alias("was_outlier"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    if keys:
        return left.join(right, keys, how)
    # Without keys the right side is one aggregate row.
    return left.transform(with_row, right, how)


def first_per_year(df: DataFrame, tiebreak: list[Column], roles: Roles = DEFAULT) -> DataFrame:
    """Rows without id dropped; of several rows for one entity-year the first by ``tiebreak`` is kept."""
    w = W.partitionBy(*roles.entity, roles.year).orderBy(*tiebreak)
    return (df.where(F.col(roles.id).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def sparse_entities(df: DataFrame, minimum: int = 3, roles: Roles = DEFAULT) -> DataFrame:
    return (df.where(F.col(roles.id).isNotNull()).groupBy(*roles.entity)
            .agg(F.countDistinct(roles.year).alias("points")).where(F.col("points") < minimum))


def entity_report(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Counts of rows without id, of repeated entity-years and of entities with fewer than three years."""
    cells = df.groupBy(*roles.entity, roles.year).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(roles.id).isNotNull()
    per_entity = cells.groupBy(*roles.entity).agg(
        F.sum("_n").alias("_rows"), F.count_if(F.col("_n") > 1).alias("_repeated"), F.count(F.lit(1)).alias("_years"))
    return per_entity.agg(F.coalesce(F.sum(F.when(~known, F.col("_rows"))), F.lit(0)).alias("missing_ids"),
                          F.coalesce(F.sum(F.when(known, F.col("_repeated"))), F.lit(0)).alias("repeated_entity_years"),
                          F.count_if(known & (F.col("_years") < 3)).alias("sparse_entities"))


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad) for boolean expressions that mark a bad row, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counted.unpivot([], list(rules), "rule", "n_bad")


def panel_rules(roles: Roles = DEFAULT, with_type: bool = False) -> dict[str, Column]:
    year, value = F.col(roles.year), F.col(roles.value)
    rules = {
        "value_missing": value.isNull() | F.isnan(value),
        "value_negative": value < 0,
        "year_missing": year.isNull(),
        "year_out_of_range": (year < 1900) | (year > 2100),
        "id_missing": F.col(roles.id).isNull(),
    }
    if with_type:
        rules["type_unknown"] = ~F.col(roles.type).isin(*ALLOWED_TYPES)
    return rules


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows, failing at the first bad one when they are read."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in rules.values()])
    names = F.concat_ws(", ", *[F.when(c, F.lit(n)) for n, c in rules.items()])
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit("bad row: "), names)).cast("boolean")).otherwise(F.lit(True)))


def quality_score(df: DataFrame, required: list[str], limits: dict[str, tuple[float | None, float | None]] | None = None,
                  min_lengths: dict[str, int] | None = None) -> DataFrame:
    """Score 0..100: 30 for the required columns, 40 for no issue, 30 for at most two warnings.

    More than 20 % missing in a column is an issue, more than 5 % a warning; values beyond ``limits``, texts shorter than
    ``min_lengths`` and repeated rows are warnings.
    """
    limits, min_lengths = limits or {}, min_lengths or {}
    checks: list[Column] = []
    n = F.col("_rows").cast("double")
    sums = [F.sum("_n").alias("_rows"), F.sum(F.col("_n") - 1).alias("_dup")]
    issues: list[Column] = []
    for i, c in enumerate(df.columns):
        sums.append(F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"_m{i}"))
        pct = F.try_divide(F.col(f"_m{i}") * 100.0, n)
        issues.append((pct > 20).cast("int"))
        checks.append(((pct > 5) & (pct <= 20)).cast("int"))
        low, high = limits.get(c, (None, None))
        for tag, bad in (("l", F.col(c) < low if low is not None else None), ("h", F.col(c) > high if high is not None else None),
                         ("s", F.length(c) < min_lengths[c] if c in min_lengths else None)):
            if bad is not None:
                sums.append(F.count_if(bad).alias(f"_{tag}{i}"))
                checks.append((F.col(f"_{tag}{i}") > 0).cast("int"))
    checks.append((F.col("_dup") > 0).cast("int"))
    absent = [c for c in required if c not in df.columns]
    table = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(*sums)
    n_issues = reduce(lambda a, b: a + b, issues) + (1 if absent else 0)
    n_warnings = reduce(lambda a, b: a + b, checks)
    missing = reduce(lambda a, b: a + b, [F.col(f"_m{i}") for i in range(len(df.columns))])
    return table.select(F.col("_rows").alias("rows"), missing.alias("missing_values"), F.col("_dup").alias("duplicate_rows"),
                        n_issues.alias("issues"), n_warnings.alias("warnings")).withColumn(
        "score", F.lit(0 if absent else 30) + F.when(F.col("issues") == 0, 40).otherwise(0)
        + F.when(F.col("warnings") <= 2, 30).otherwise(0))


def share_totals(df: DataFrame, share: str = "market_share", roles: Roles = DEFAULT) -> DataFrame:
    """Per market-year: share sum, its distance from 100, whether that passes, and counts of odd shares."""
    s = F.col(share)
    return (df.groupBy(*roles.period).agg(F.sum(s).alias("share_sum"), F.count_if((s < 0) | s.isNull()).alias("invalid_shares"),
                                          F.count_if(s > 50).alias("dominant_shares"))
            .withColumn("deviation", F.abs(F.col("share_sum") - 100))
            .withColumn("status", S.bands("deviation", [(1.0, "critical"), (0.01, "warning")], "ok", strict=True)))


def total_against_world(df: DataFrame, world: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Entity sum per market-year against the total series, with 0.1 % and 1 % bands."""
    sums = df.groupBy(*roles.period).agg(F.sum(roles.value).alias("entity_total"))
    pct = F.when(F.col("world_total") > 0, F.abs(F.col("entity_total") - F.col("world_total")) / F.col("world_total") * 100)
    return (sums.join(world.select(*roles.period, F.col(roles.value).alias("world_total")), roles.period)
            .withColumn("deviation_pct", pct)
            .withColumn("status", F.when(F.col("deviation_pct").isNull() | (F.col("deviation_pct") > 1), "critical")
                        .when(F.col("deviation_pct") > 0.1, "warning").otherwise("ok")))


def group_total_errors(df: DataFrame, group: list[str], value: str, expected: float, tolerance_pct: float = 0.01) -> DataFrame:
    """Groups whose sum is off the expected total by more than the tolerance in %."""
    off = F.abs(F.col("total") - expected) / expected * 100 if expected > 0 else F.lit(float("inf"))
    return df.groupBy(*group).agg(F.sum(value).alias("total")).withColumn("deviation_pct", off).where(F.col("deviation_pct") > tolerance_pct)


def series_report(df: DataFrame, key: str = "key", date: str = "date", value: str = "value", minimum: int = 3) -> DataFrame:
    """Per series: missing and infinite values, zero variance, repeated dates, gaps over five times the median gap, length."""
    w = W.partitionBy(key).orderBy(date)
    gaps = df.withColumn("_gap", F.date_diff(F.col(date), F.lag(date).over(w)).cast("double"))
    v = S.finite(value)
    stats = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("missing"),
        F.count_if(F.abs(value) == float("inf")).alias("infinite"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("_var"),
        F.count_if(F.col("_gap") == 0).alias("repeated_dates"), F.percentile("_gap", F.lit(0.5)).alias("median_gap"),
        F.max("_gap").alias("largest_gap"))
    return stats.select(key, "points", "missing", "infinite", "repeated_dates", "median_gap", "largest_gap",
                        (F.col("_var") == 0).alias("constant"), (F.col("points") < minimum).alias("too_short"),
                        F.coalesce(F.col("largest_gap") > 5 * F.col("median_gap"), F.lit(False)).alias("has_gap"))


def repair_series(df: DataFrame, key: str = "key", date: str = "date", value: str = "value", sigmas: float = 3.0) -> DataFrame:
    """Forward fill, then backward fill, then clip to the mean and three standard deviations of the filled series."""
    v = S.finite(value)
    ordered = W.partitionBy(key).orderBy(date)
    forward = F.last(v, True).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    backward = F.first(v, True).over(ordered.rowsBetween(0, W.unboundedFollowing))
    filled = df.withColumn("_filled", F.coalesce(forward, backward))
    whole = W.partitionBy(key)
    filled = filled.withColumn("_m", F.avg("_filled").over(whole)).withColumn("_s", F.stddev_samp("_filled").over(whole))
    clipped = F.when(F.col("_s") > 0, S.clip("_filled", F.col("_m") - sigmas * F.col("_s"), F.col("_m") + sigmas * F.col("_s"))).otherwise(F.col("_filled"))
    return filled.withColumn(value, clipped).drop("_filled", "_m", "_s")
