"""Stored quantile sketches: percentiles of draws that arrive in lots, without reading the earlier lots again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Size parameter of a sketch: up to about so many values it is exact, beyond that the rank error is near 1.33 % at 200 and falls almost in proportion.
SIZE = 200


def sketches(rows: DataFrame, keys: Sequence[str], value: str = "value", size: int = SIZE) -> DataFrame:
    """(keys…, sketch): a mergeable sketch of each group's values; nulls and NaN are left out, and a group with nothing else has none.

    Sketches are filled in every task before the shuffle, so a group that holds a third of all rows moves as one sketch a task.
    """
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merged(stored: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """One sketch a group out of many; ``keys`` may also be coarser than those of the stored ones."""
    return stored.where("sketch is not null").groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def store(rows: DataFrame, keys: Sequence[str], path: str, lot: int, value: str = "value", size: int = SIZE) -> None:
    """Write the sketches of one lot of draws to ``path``. A lot that is written again replaces itself, so a failed job can be repeated."""
    sketches(rows, keys, value, size).write.mode("overwrite").parquet(f"{path}/lot={int(lot)}")


def stored(spark: SparkSession, path: str, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys…, sketch) over all lots in ``path``."""
    return merged(spark.read.parquet(path), keys, size)


def quantile(p: float, sketch: Column | str = "sketch") -> Column:
    """Smallest value with a share of at least ``p`` of the draws at or below it."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(p)))


def bands(found: DataFrame, keys: Sequence[str], levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(keys…, n, p5, p25, …)."""
    return found.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), *[quantile(p).alias(f"p{round(p * 100):d}") for p in levels])


def rank_errors(found: DataFrame, rows: DataFrame, keys: Sequence[str], value: str = "value", levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(keys…, n, rank_error): largest distance between a level and the ranks that its sketched value really has, from one aggregate over all rows.

    A value that occurs more than once has all ranks from the first to the last of its copies.
    """
    v = F.col(value).cast("double")
    cuts = bands(found, keys, levels).drop("n")
    clean = rows.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")).join(cuts, list(keys))
    names = [f"p{round(p * 100):d}" for p in levels]
    n = F.count(F.lit(1)).alias("n")
    counts = clean.groupBy(*keys).agg(n, *[F.count_if(F.col("_v") < F.col(c)).alias(f"_l{c}") for c in names], *[F.count_if(F.col("_v") <= F.col(c)).alias(f"_h{c}") for c in names])
    off = [F.greatest(F.col(f"_l{c}") / F.col("n") - p, p - F.col(f"_h{c}") / F.col("n"), F.lit(0.0)) for c, p in zip(names, levels)]
    return counts.select(*keys, "n", F.greatest(*off, F.lit(0.0)).alias("rank_error"))
