"""Learned calibration on a stream: plain loops over sorted records, any cut into batches, restarts, degenerate input."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from panelloom.functions.session import run_folder
from panelloom.streaming import actuals as st
from panelloom.streaming.learning import learned_calibration

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, actual double"
COLUMNS = ("key", "end", "version", "n", "actual", "forecast", "factor", "bias", "recent_mean")


def rows():
    """Forty days; c is silent for days 8 to 29, d has no forecast, e a day without a total, a null key and a null time are there."""
    out = []
    for day in range(40):
        at = START + dt.timedelta(days=day, hours=3)
        out += [("a", at, 10.0 + day), ("a", at, 4.0), ("b", at, 20.0 - day / 4)]
        if not 8 <= day < 30:
            out.append(("c", at, 7.0 + day % 3))
        if day % 5 == 0:
            out += [("d", at, 3.0), ("e", at, 0.0 if day == 10 else 9.0), ("e", at, None), (None, at, 2.0)]
    return [*out, ("a", None, 5.0)]


FORECASTS = [("a", 9.0), ("b", 15.0), ("c", 8.0), ("e", 12.0), (None, 1.0)]


def loops(data, silence=14):
    totals, forecast, out = {}, {k: f for k, f in FORECASTS if k is not None}, []
    for key, ts, actual in data:
        if ts is not None:
            cell = totals.setdefault(key, {}).setdefault(ts.date(), [0, 0, None])
            cell[0] += 1
            if actual is not None:
                cell[1] += 1
                cell[2] = (cell[2] or 0.0) + actual
    closed = (max(t for _, t, _ in data if t is not None) - dt.timedelta(minutes=10)).date()
    for key, days in totals.items():
        factor, version, errors, before = 1.0, 0, [], None
        for day in sorted(d for d in days if d < closed):
            if before is not None and (day - before).days > silence:
                factor, version, errors = 1.0, 0, []
            n, known, actual = days[day]
            version, before = version + 1, day
            value = None if key not in forecast else factor * (forecast[key] * known)
            bias = None if value is None or not actual or actual < 0 else (value - actual) / actual * 100
            errors = (errors + [None if bias is None else abs(bias)])[-5:]
            seen = [e for e in errors if e is not None]
            out.append((key, day, version, n, actual, value, factor, bias, sum(seen) / len(seen) if seen else None))
            if bias is not None and abs(bias) > 10:
                factor *= min(max(1 - bias / 200, 0.5), 1.5)
    return out


def plain(found):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in found), key=repr)


def read(df):
    day = F.to_date(F.col("end") - F.expr("interval 1 day"))
    return plain(tuple(x) for x in df.select(*[day.alias("end") if c == "end" else c for c in COLUMNS]).collect())


def write(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(spark):
    return f"{run_folder(spark)}/actuals-{uuid.uuid4().hex}"


def learn(spark, folder, files=None, base=None):
    forecasts = spark.createDataFrame(FORECASTS, "key string, forecast double")
    stream = st.read_stream(spark, folder, "*.parquet", files)
    return st.run_available(learned_calibration(stream, forecasts, ["key"]), base, keyed_state=True)


def test_equals_loops(spark, folder):
    data = rows()
    write(spark, folder, data)
    found = learn(spark, folder)
    assert read(found) == plain(loops(data))
    again = [r.version for r in found.where("key = 'c'").orderBy("end").collect()]
    assert again == [*range(1, 9), *range(1, 10)]
    assert {r.trend for r in found.where("key = 'd'").collect()} == {"insufficient_data"}


def test_batches_and_restart(spark, folder):
    """Four files one at a time, the last two after a restart from the checkpoint."""
    data = sorted(rows(), key=lambda r: r[1] or START)
    base, cuts = f"{folder}-run", [0, len(data) // 4, len(data) // 2, 3 * len(data) // 4, len(data)]
    for i in (0, 1):
        write(spark, folder, data[cuts[i]:cuts[i + 1]])
    first = read(learn(spark, folder, 1, base))
    assert first == plain(loops(data[:cuts[2]]))
    for i in (2, 3):
        write(spark, folder, data[cuts[i]:cuts[i + 1]])
    assert read(learn(spark, folder, 1, base)) == plain(loops(data))


def test_trend_classes(spark, folder):
    """Errors that fall or rise by a steady step are told from flat ones."""
    data = [("a", START + dt.timedelta(days=i, hours=1), 10.0 / (1 + e / 100)) for i, e in enumerate([9, 7, 5, 3, 1, 1])] + [
        ("b", START + dt.timedelta(days=i, hours=1), 15.0 / (1 + e / 100)) for i, e in enumerate([1, 3, 5, 7, 9, 9])] + [
        ("c", START + dt.timedelta(days=i, hours=1), 8.0) for i in range(6)]
    write(spark, folder, [(k, t, a * 9 / 10 if k == "a" else a) for k, t, a in data])
    last = {r.key: (r.trend, r.slope) for r in learn(spark, folder).where("version = 5").collect()}
    assert last["a"][0] == "improving" and last["a"][1] == pytest.approx(-2.0)
    assert last["b"][0] == "deteriorating" and last["b"][1] == pytest.approx(2.0)
    assert last["c"] == ("no_trend", 0.0)


def test_empty(spark, folder):
    write(spark, folder, [])
    assert learn(spark, folder).count() == 0


def test_settings_are_put_back(spark, folder):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    write(spark, folder, [("a", START, 1.0)])
    learn(spark, folder)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
