"""Accuracy of forecasts against a stream of actual values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelloom.functions.session import run_folder

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def instant(ts: str) -> Column:
    """Wall-clock timestamp as the same instant in UTC whatever the session time zone, so that day windows start at midnight."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {ts}))")


def wall_clock(ts: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({ts}), {_EPOCH})")


def windowed_accuracy(actuals: DataFrame, forecasts: DataFrame, key: str, by: list[str], width: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """Error per tumbling window and group. ``actuals(key, ts, actual, by…)`` may be a stream, ``forecasts(key, forecast)`` is static.

    Rows later than ``lateness`` are dropped by the watermark, so state is bounded by the windows still open.
    """
    e = F.col("forecast") - F.col("actual")
    rows = actuals.withWatermark("ts", lateness).join(forecasts, key)
    return (rows.groupBy(F.window("ts", width).alias("_w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
            .select(F.col("_w.start").alias("window_start"), *by, "n", "mae", "rmse", "bias"))


def read_stream(spark: SparkSession, folder: str, glob: str, files: int | None = None) -> DataFrame:
    """Stream of the Parquet files of ``folder``, at most ``files`` new ones a batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)


_PREFIX = "spark.sql.streaming.stateStore"
# Stores are many and small: space is not reserved ahead, and a batch writes its changes instead of a whole copy.
_KEYED = {f"{_PREFIX}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          f"{_PREFIX}.rocksdb.allowFAllocate": "false", f"{_PREFIX}.rocksdb.changelogCheckpointing.enabled": "true"}


def run_available(stream: DataFrame, base: str | None = None, keyed_state: bool = False) -> DataFrame:
    """Process everything available now into a Parquet sink of the shared folder and read it back.

    With the ``base`` of an earlier run it goes on from that run's offsets and state. ``keyed_state`` asks for the store
    that arbitrary state needs; a running query keeps its own settings, so the session's is put back at once.
    """
    spark = stream.sparkSession
    base = base or f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    settings = _KEYED if keyed_state else {}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).start())
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
