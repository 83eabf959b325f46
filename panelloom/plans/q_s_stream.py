"""Forecast accuracy, and calibration learned from it, on a stream of actual values."""

from pyspark.sql import functions as F

from panelloom.functions.stats import critical_t
from panelloom.plans.base import ctes, money, query, r, table, tidy
from panelloom.streaming import actuals as st
from panelloom.streaming.learning import learned_calibration


@query("s01_stream_accuracy", ctes(f="SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS forecast FROM events GROUP BY 1",
                                   j="SELECT CAST(ts AS DATE) AS day, event_type, value AS actual, forecast FROM events JOIN f USING (user_id)") + f"""
  SELECT day, event_type, count(*)::BIGINT AS n, {r('avg(abs(forecast - actual))')} AS mae, {r('sqrt(avg((forecast - actual) ** 2))')} AS rmse, {r('avg(forecast - actual)')} AS bias
  FROM j WHERE day < (SELECT CAST(max(ts) - INTERVAL 10 MINUTE AS DATE) FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    forecasts = table(spark, sf, "events").groupBy("user_id").agg((money("value") / F.count(F.lit(1))).alias("forecast"))
    rows = st.read_stream(spark, sf, "events.parquet").select("user_id", st.instant("ts").alias("ts"), F.col("value").alias("actual"), "event_type")
    out = st.run_available(st.windowed_accuracy(rows, forecasts, "user_id", ["event_type"]))
    return tidy(out.withColumn("day", st.wall_clock("window_start").cast("date")), day="date", event_type="string", n="bigint", mae=6, rmse=6, bias=6)


_SILENT = 3
_CRITICAL = " ".join(f"WHEN {n} THEN {critical_t(0.05, n - 2) ** 2}" for n in (3, 4, 5))


@query("s01_stream_learning", ctes(
    f="SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS forecast FROM events GROUP BY 1",
    d="""SELECT user_id, day, n, actual, k * forecast AS forecast FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(value) AS k, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS actual
  FROM events WHERE ts IS NOT NULL GROUP BY 1, 2) LEFT JOIN f USING (user_id) WHERE day < (SELECT CAST(max(ts) - INTERVAL 10 MINUTE AS DATE) FROM events)""",
    g=f"SELECT *, sum(CASE WHEN gap > {_SILENT} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS life FROM (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d)",
    v="SELECT *, row_number() OVER (PARTITION BY user_id, life ORDER BY day) AS version FROM g",
    w="""SELECT user_id, life, version, day, n, actual, forecast, CAST(1 AS DOUBLE) AS factor, CASE WHEN actual > 0 THEN (forecast - actual) / actual * 100 END AS bias FROM v WHERE version = 1
  UNION ALL SELECT user_id, life, version, day, n, actual, base * factor, factor, CASE WHEN actual > 0 THEN (base * factor - actual) / actual * 100 END FROM (
    SELECT v.user_id, v.life, v.version, v.day, v.n, v.actual, v.forecast AS base,
      w.factor * CASE WHEN abs(w.bias) > 10 THEN least(greatest(1 - 0.5 * w.bias / 100, 0.5), 1.5) ELSE 1 END AS factor
    FROM w JOIN v ON v.user_id IS NOT DISTINCT FROM w.user_id AND v.life = w.life AND v.version = w.version + 1)""",
    t="""SELECT *, count(bias) OVER o AS k, avg(abs(bias)) OVER o AS recent_mean, regr_slope(abs(bias), version) OVER o AS slope, corr(abs(bias), version) OVER o AS c FROM w
  WINDOW o AS (PARTITION BY user_id, life ORDER BY version ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""") + f"""
  SELECT user_id, day, version::BIGINT AS version, n::BIGINT AS n, {r('actual')} AS actual, {r('forecast')} AS forecast, {r('factor')} AS factor, {r('bias')} AS bias, {r('recent_mean')} AS recent_mean,
    {r('CASE WHEN k > 1 THEN slope END')} AS slope, CASE WHEN k < 3 THEN 'insufficient_data' WHEN c IS NULL OR isnan(c) OR c * c * (k - 2) <= (CASE k {_CRITICAL} END) * (1 - c * c) THEN 'no_trend'
    WHEN slope < -0.5 THEN 'improving' WHEN slope > 0.5 THEN 'deteriorating' ELSE 'stable' END AS trend FROM t""")
def _(spark, sf):
    forecasts = table(spark, sf, "events").groupBy("user_id").agg((money("value") / F.count(F.lit(1))).alias("forecast"))
    rows = st.read_stream(spark, sf, "events.parquet").select("user_id", st.instant("ts").alias("ts"), F.col("value").cast("decimal(18,2)").alias("actual"))
    out = st.run_available(learned_calibration(rows, forecasts, ["user_id"], silence_days=_SILENT), keyed_state=True)
    return tidy(out.withColumn("day", st.wall_clock("end - interval 1 day").cast("date")), user_id="bigint", day="date", version="bigint", n="bigint", actual=6, forecast=6, factor=6, bias=6,
                recent_mean=6, slope=6, trend="string")
