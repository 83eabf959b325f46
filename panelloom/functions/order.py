"""Exact ranks and quantiles inside groups of any size.

A plain ``rank() over (partition by year)`` sends every entity of a year to one task. Here the distinct order keys of a big
group are first cut into buckets whose bounds come from a key-hash sample of the data itself (same rows on every run, so a
lost executor recomputes the same cut), positions are counted inside a bucket, and bucket offsets are added. Small groups stay
in one bucket, so they pay nothing for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from panelloom.functions.session import with_row

PER_BUCKET = 50_000


def _bucket(bounds: Column, strides: Column, value: Column) -> Column:
    """Number of sorted bounds at or below ``value`` (null bounds: bucket 0).

    ``strides`` are falling powers of two: each is added while the bound it lands on is still at or below the value. A step past
    the end reads null and is not taken.
    """
    found = F.aggregate(strides, F.lit(0), lambda at, w: F.when(F.get(bounds, at + w - 1) <= value, at + w).otherwise(at))
    return F.coalesce(found, F.lit(0))


def positions(df: DataFrame, by: Sequence[str], order: Column | Sequence[Column], per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per distinct order key: ``(by…, _key, _n, _below, _distinct_below, _total)``.

    ``_n`` is the number of rows with that key, ``_below`` the number of rows with a smaller one, ``_total`` the group size.
    Row number, rank, dense rank, average rank and every quantile follow from these by arithmetic. Null keys are left out.
    """
    by = list(by)
    key = order if isinstance(order, Column) else F.struct(*order)
    counts = (df.select(*by, key.alias("_key")).where(F.col("_key").isNotNull())
              .groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n")))
    sampled = F.pmod(F.xxhash64("_key"), F.lit(per_bucket)) == 0
    cuts = (counts.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("_d"),
                 F.sort_array(F.collect_list(F.when(sampled, F.col("_key")))).alias("_cuts"))
            .where(F.col("_d") > per_bucket).drop("_d"))
    top = F.floor(F.log2(F.size("_cuts").cast("double") + 1)).cast("int")
    cuts = cuts.withColumn("_strides", F.transform(F.sequence(top, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k)))
    placed = _left(counts, cuts, by).withColumn("_bucket", _bucket(F.col("_cuts"), F.col("_strides"), F.col("_key"))).drop("_cuts", "_strides")
    inside = W.partitionBy(*by, "_bucket").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    local = placed.select(*by, "_bucket", "_key", "_n",
                          F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_b"),
                          F.count("_n").over(inside).alias("_db"))
    # One row per bucket: a table smaller than the data by the bucket size. It is taken from the counted rows, which are already
    # clustered by bucket, so the placed rows are shuffled once for both uses.
    sums = local.groupBy(*by, "_bucket").agg(F.max(F.col("_b") + F.col("_n")).alias("_bn"), F.max(F.col("_db") + 1).alias("_bd"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = sums.select(*by, "_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_o"),
                          F.coalesce(F.sum("_bd").over(before), F.lit(0)).alias("_od"),
                          F.sum("_bn").over(whole).alias("_total"))
    return (local.join(offsets, [*by, "_bucket"])
            .select(*by, "_key", "_n", (F.col("_b") + F.col("_o")).alias("_below"),
                    (F.col("_db") + F.col("_od")).alias("_distinct_below"), "_total"))


def _left(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return df.join(other, by, "left")
    # A single group: the other side is one row by construction.
    return df.transform(with_row, other, "left")


def with_ranks(df: DataFrame, by: Sequence[str], order: Column | Sequence[Column], **named: str) -> DataFrame:
    """Add rank columns. Keywords map a rank kind to the output column name.

    Kinds: ``rank`` (ties share the lowest), ``dense``, ``average``, ``fraction`` (average rank over group size) and
    ``size``. Rows with a null order key get null ranks.
    """
    by = list(by)
    key = order if isinstance(order, Column) else F.struct(*order)
    formulas = {
        "rank": F.col("_below") + 1,
        "dense": F.col("_distinct_below") + 1,
        "average": F.col("_below") + (F.col("_n") + 1) / 2,
        "fraction": (F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total"),
        "size": F.col("_total"),
    }
    table = positions(df, by, key).select(*by, "_key", *[formulas[k].alias(v) for k, v in named.items()])
    return df.withColumn("_key", key).join(table, [*by, "_key"], "left").drop("_key")


def quantiles(df: DataFrame, by: Sequence[str], value: Column | str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group as one column per entry of ``probabilities``."""
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    table = positions(df, by, value)
    found = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(place), F.ceil(place)
        found += [F.max(F.when((F.col("_below") <= at) & (at < F.col("_below") + F.col("_n")), F.col("_key"))).alias(f"_{end}_{name}")
                  for end, at in (("lo", low), ("hi", high))]
    rows = table.groupBy(*by).agg(*found, F.max("_total").alias("_total"))
    out = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return rows.select(*by, *out)
