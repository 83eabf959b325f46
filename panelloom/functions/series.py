"""Recurrences over one ordered series, shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelloom.functions import folds


def growth_bounds(df: DataFrame, key: list[str], order: str, value: str, low: float = -30.0, high: float = 50.0, back: int = 1) -> DataFrame:
    """Hold growth between ``low`` and ``high`` % against the already limited value ``back`` rows earlier.

    Rows that are ``back`` apart form independent chains, so each chain is one fold with a single remembered value.
    """
    w = W.partitionBy(*key).orderBy(order)
    chained = df.withColumn("_chain", F.pmod(F.row_number().over(w) - 1, F.lit(back)))

    def limited(previous: Column, now: Column) -> Column:
        growth = (F.try_divide(now, previous) - 1) * 100
        return (F.when(previous.isNull() | now.isNull() | (previous <= 0), now).when(growth > high, previous * (1 + high / 100))
                .when(growth < low, previous * (1 + low / 100)).otherwise(now))

    done = folds.scan_rows(chained, [*key, "_chain"], order, {"v": F.lit(None).cast("double")},
                           lambda s, x: {"v": limited(s["v"], x[value])}, lambda s, x: {"_new": s["v"]}, "_new double")
    return done.drop(value, "_chain").withColumnRenamed("_new", value).select(*df.columns)


def ewm(df: DataFrame, key: list[str], order: str, value: str, alpha: float, out: str) -> DataFrame:
    """Exponentially weighted mean without bias adjustment."""
    return folds.scan_rows(df, key, order, {"v": F.lit(None).cast("double")},
                           lambda s, x: {"v": F.when(s["v"].isNull(), x[value]).when(x[value].isNull(), s["v"])
                                         .otherwise(alpha * x[value] + (1 - alpha) * s["v"])},
                           lambda s, x: {out: s["v"]}, f"{out} double")
