"""Sinks: long results partitioned by year, wide tables, append-only calibration history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelloom.operators import shares as sh
from panelloom.roles import DEFAULT, Roles
from panelloom.sources.readers import long_to_wide


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", roles: Roles = DEFAULT) -> None:
    """One folder per year. Rows are gathered by year, and large years are split at run time into as many writers as their size asks for."""
    writer = df.hint("rebalance", F.col(roles.year)).write.mode(mode).partitionBy(roles.year)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_wide(df: DataFrame, path: str, years: list[int] | None = None, fmt: str = "parquet", mode: str = "errorifexists",
               roles: Roles = DEFAULT) -> None:
    writer = long_to_wide(df, years, "sum", roles).write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def export_table(df: DataFrame, label: str, roles: Roles = DEFAULT) -> DataFrame:
    """The panel with share, growth and an export label, ready for a sink."""
    shared = sh.market_shares(df, roles)
    w = W.partitionBy(*roles.entity).orderBy(roles.year)
    return (shared.withColumn("growth_rate", (F.try_divide(F.col(roles.value), F.lag(roles.value).over(w)) - 1) * 100)
            .withColumn("export_label", F.lit(label)))


def append_history(df: DataFrame, path: str, run: int) -> None:
    """Add one calibration run as its own partition; earlier runs are never rewritten."""
    df.withColumn("calibration_id", F.lit(run)).write.mode("append").partitionBy("calibration_id").parquet(path)


def load_history(spark: SparkSession, path: str, keep: int = 5) -> DataFrame:
    """Rows of the last ``keep`` runs. Partition values alone decide, so older partitions are never read."""
    rows = spark.read.parquet(path)
    last = rows.select("calibration_id").distinct().orderBy(F.desc("calibration_id")).limit(keep)
    return rows.join(F.broadcast(last), "calibration_id", "left_semi")

