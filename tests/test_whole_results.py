"""Nothing is lost without notice: markets that end in different years, gaps in the totals, long cycles, short or gapped series, zeros."""

import math

import pytest
from pyspark.sql import functions as F

from panelloom.operators import forecast as fc, regions as rg, shares as sh
from panelloom.sources import readers as R, sinks


def test_distribute_keeps_every_market_year(spark):
    rows = [(m, i, f"e{i}", y, 10.0 * i + y - 1990) for m, last in (("a", 2003), ("b", 2005)) for i in (1, 2, 3) for y in range(1998, last + 1)]
    history = spark.createDataFrame(rows, "market string, id long, name string, year int, value double")
    sums = {}
    for m, _, _, y, v in rows:
        sums[m, y] = sums.get((m, y), 0.0) + v
    gone = {("a", 2001), ("b", 2001), ("b", 2002)}
    world = spark.createDataFrame([(m, y, v) for (m, y), v in sums.items() if (m, y) not in gone] + [("a", 1995, 50.0)], "market string, year int, value double")
    out = sh.distribute(history, world, 3).collect()
    got = {}
    for r in out:
        got.setdefault((r.market, r.year), {})[r.id] = r.value
    assert set(got) == {("a", y) for y in (1995, *range(1998, 2007))} | {("b", y) for y in range(1998, 2009)}
    assert all(set(v) == {1, 2, 3} and all(x is not None and x >= 0 for x in v.values()) for v in got.values())
    for key, total in sums.items():
        if key not in gone:
            assert sum(got[key].values()) == pytest.approx(total, rel=1e-6)
    assert sum(got["a", 1995].values()) == pytest.approx(50.0, rel=1e-6)
    assert sum(got["a", 2001].values()) == pytest.approx((sums["a", 2000] + sums["a", 2002]) / 2, rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 100])
def test_cycles_of_any_length(spark, n):
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [("top", "r0"), ("r0", "leaf"), ("leaf", "below")]
    edges = spark.createDataFrame(ring, "parent string, child string")
    assert {r.region for r in rg.cycles(edges).collect()} == {f"r{i}" for i in range(n)}
    with pytest.raises(ValueError, match="cycle"):
        rg.closure(edges)


def test_deep_hierarchy_has_no_cycle(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "parent string, child string")
    assert rg.cycles(edges).count() == 0
    assert rg.closure(edges).count() == 20 * 21 // 2


def test_every_key_has_every_step(spark):
    rows = [("long", f"2000-{m:02d}-01", float(m)) for m in range(1, 13) if m != 3] + [("short", "2000-12-01", 5.0), ("pair", "2000-11-01", 1.0), ("pair", "2000-12-01", 3.0)]
    series = spark.createDataFrame(rows, "key string, date string, value double").withColumn("date", F.to_date("date"))
    models = ["seasonal_naive", "autoregressive", "exponential_smoothing", "linear", "naive"]
    out = fc.forecast_many(series, models, 6, exponential_smoothing={"kind": "triple"}).collect()
    count = {}
    for r in out:
        count[r.model, r.key] = count.get((r.model, r.key), 0) + 1
    names = {m for m, _ in count}
    assert len(names) == 5 and all(count[m, k] == 6 for m in names for k in ("long", "short", "pair"))
    gap = [r for r in out if r.model == "seasonal_naive" and r.key == "long"]
    assert [r.reason for r in sorted(gap, key=lambda r: r.horizon)] == [None, None, "no value of the model", None, None, None]


def test_curves_are_scored_on_every_row(spark):
    values = [0.0, 0.0, 3.0, 9.0, 20.0, 33.0, 41.0, 45.0]
    series = spark.createDataFrame([("k", f"{2000 + t}-01-01", v) for t, v in enumerate(values)], "key string, date string, value double").withColumn("date", F.to_date("date"))
    for curve, shape in (("logistic", lambda t, a, b, c: a / (1 + math.exp(-c * (t - b)))), ("gompertz", lambda t, a, b, c: a * math.exp(-b * math.exp(-c * t)))):
        r = fc.fit_curves(series, curve).first()
        assert r.sse == pytest.approx(sum((v - shape(t, r.a, r.b, r.c)) ** 2 for t, v in enumerate(values)))


def test_pivot_holds_every_year(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, "a", 1890, 1.0), ("m", 1, "a", 2040, 2.0)], "market string, id long, name string, year int, value double")
    assert R.long_to_wide(df).columns[-2:] == ["1890", "2040"]
    sinks.write_panel(df, str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 2


def test_release_leaves_nothing(spark, tmp_path):
    import os

    from panelloom.functions import session
    folder = session.run_folder(spark)
    rows = session.cut_lineage(spark.range(5)).collect()
    assert len(rows) == 5 and os.path.isdir(folder.removeprefix("file://"))
    session.release(spark)
    assert not os.path.exists(folder.removeprefix("file://")) and session.run_folder(spark) != folder
