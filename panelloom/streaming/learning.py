"""Calibration learned from a stream of actual values: one small state per key, kept across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from panelloom.functions.stats import critical_t
from panelloom.roles import CalibrationSettings

_STATE = "end long, version long, factor double, errors array<double>"
_OUT = "version long, n long, actual double, forecast double, factor double, bias double, recent_mean double, slope double, trend string"
_DAY = 86_400_000


class _Learner(StatefulProcessor):
    """Walks the closed periods of one key in time order; the state is the last period, the version, the factor and the last errors."""

    def __init__(self, key: list[str], silence: int, last: int, limit: float, settings: CalibrationSettings):
        self.key, self.silence, self.last, self.limit = key, silence, last, limit
        self.gate, self.share = settings.bias_gate, settings.bias_share
        self.critical = {n: critical_t(0.05, n - 2) ** 2 for n in range(3, last + 1)}

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("calibration", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get()
        timer = kept is not None
        end, version, factor, errors = kept if timer else (None, 0, 1.0, [])
        errors = list(errors)
        for row in sorted(rows, key=lambda x: x._end):
            if end is not None and row._end <= end:
                continue
            if end is not None and row._end - end > self.silence:
                version, factor, errors = 0, 1.0, []
            end, version = row._end, version + 1
            forecast = None if row._forecast is None else factor * row._forecast
            bias = None if forecast is None or row._actual is None or row._actual <= 0 else (forecast - row._actual) / row._actual * 100
            errors = [*errors, None if bias is None else abs(bias)][-self.last:]
            mean, slope, trend = self.trend(errors)
            yield Row(**dict(zip(self.key, key)), end=end, version=version, n=row._n, actual=row._actual, forecast=forecast, factor=factor, bias=bias,
                      recent_mean=mean, slope=slope, trend=trend)
            if bias is not None and abs(bias) > self.gate:
                factor *= min(max(1 - self.share * bias / 100, 0.5), 1.5)
        if end is not None:
            self.state.update((end, version, factor, errors))
            if not timer:
                self.handle.registerTimer(end + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Forget a key that was silent long enough; one that spoke since is looked at again later."""
        kept = self.state.get()
        if kept is not None and kept[0] + self.silence > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(kept[0] + self.silence)
        else:
            self.state.clear()
        return iter(())

    def trend(self, errors: list) -> tuple:
        points = [(float(i), e) for i, e in enumerate(errors) if e is not None]
        n = len(points)
        if not n:
            return None, None, "insufficient_data"
        mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
        sxx, sxy, syy = (sum((x - mx) ** 2 for x, _ in points), sum((x - mx) * (y - my) for x, y in points), sum((y - my) ** 2 for _, y in points))
        slope = sxy / sxx if n > 1 else None
        if n < 3:
            return my, slope, "insufficient_data"
        r2 = sxy * sxy / (sxx * syy) if syy > 0 else 0.0
        if r2 * (n - 2) <= self.critical[n] * (1 - r2):
            return my, slope, "no_trend"
        return my, slope, "improving" if slope < -self.limit else "deteriorating" if slope > self.limit else "stable"

    def close(self) -> None:
        pass


def learned_calibration(actuals: DataFrame, forecasts: DataFrame, key: list[str], period: str = "1 day", lateness: str = "10 minutes", silence_days: int = 14,
                        last: int = 5, limit: float = 0.5, settings: CalibrationSettings = CalibrationSettings()) -> DataFrame:
    """One row per key and closed period: the corrected forecast, its error, and what was learned from it.

    ``actuals(key…, ts, actual)`` is a stream, ``forecasts(key…, forecast)`` static with a forecast of one actual value. A period's totals are
    built by the engine's own windows (partial sums before the shuffle, so a hot key costs nothing more) and go on once, when the watermark
    passes its end. Then, per key: the forecast is multiplied by the key's ``factor``, the bias in percent is taken, ``recent_mean``, ``slope`` and ``trend``
    describe the last ``last`` errors, and a bias over the gate moves the factor by its share (a step within 0.5 to 1.5) for later periods.
    ``version`` counts the periods learned from. After more than ``silence_days`` without a period a key starts afresh; a timer frees
    its state, and the result doesn't depend on when it fires nor on how the stream was cut into batches. State per key is bounded by ``last``.

    Null ``ts`` belongs to no period. Null actuals count in ``n`` only; a period whose total isn't positive, or a key without a
    forecast, has a null bias and teaches nothing. Null keys are a key, but have no forecast. Repeated rows count as often as they come.
    """
    records = (actuals.withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("window"), *key)
               .agg(F.count(F.lit(1)).alias("_n"), F.count("actual").alias("_k"), F.sum("actual").cast("double").alias("_actual"))
               .join(forecasts.select(*key, F.col("forecast").cast("double").alias("_f")), key, "left")
               .select(*key, "window", "_n", "_actual", (F.col("_f") * F.col("_k")).alias("_forecast"), F.unix_millis("window.end").alias("_end")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in key)
    processor = _Learner(key, silence_days * _DAY, last, limit, settings)
    out = records.groupBy(*key).transformWithState(processor, f"{fields}, end long, {_OUT}", "Append", "EventTime")
    return out.withColumn("end", F.timestamp_millis("end"))
