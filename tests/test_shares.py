"""Distribution: properties and degenerate input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import forecast as fc, regions as rg, report as rp, shares as sh
from panelloom.roles import DEFAULT, DistributionSettings


def test_shares_sum_to_100_and_skip_nulls(panel):
    got = sh.market_shares(panel).groupBy("market", "year").agg(F.sum("market_share").alias("s")).collect()
    assert all(x.s == pytest.approx(100) for x in got)
    first = {x.id: x.market_share for x in sh.market_shares(panel).where("year = 2018").collect()}
    assert first[1] == pytest.approx(100 / 270 * 100) and first[2] == pytest.approx(80 / 270 * 100)
    assert sh.market_shares(panel).where("market = 'solo'").agg(F.min("market_share")).head()[0] == 100.0


@pytest.mark.parametrize("policy,rows", [("skip", 0), ("zero", 2), ("interpolate", 2)])
def test_zero_total(spark, policy, rows):
    z = spark.createDataFrame([("m", 1, "a", 2020, 0.0), ("m", 2, "b", 2020, 0.0)], "market string, id long, name string, year int, value double")
    assert sh.market_shares(z, zero_policy=policy).count() == rows


def test_empty_panel(spark, panel):
    empty = panel.limit(0)
    s = sh.market_shares(empty)
    assert s.count() == 0 and sh.share_trends(s).count() == 0 and sh.project_shares(s, 2).count() == 0
    assert rp.concentration(empty, ["market", "year"]).count() == 0


def test_no_by_columns(panel):
    roles = DEFAULT.with_(by=())
    one = panel.where("market = 'm'").drop("market")
    s = sh.market_shares(one, roles)
    got = sh.project_shares(s, 2, roles=roles).groupBy("year").agg(F.sum("market_share").alias("s")).collect()
    assert sorted(x.year for x in got) == [2021, 2022] and all(x.s == pytest.approx(100) for x in got)
    assert sh.growth_limits(s, roles).count() == 1


@pytest.mark.parametrize("floor", [None, 5.0])
def test_normalize(spark, floor):
    df = spark.createDataFrame([("g", 1, 50.0), ("g", 2, 1.0), ("g", 3, 149.0), ("h", 1, 0.0), ("h", 2, 0.0), ("n", 1, 10.0), ("n", 2, -4.0), ("n", 3, 30.0)], "g string, id long, v double")
    got = {}
    for x in sh.normalize(df, ["g"], "v", 100.0, floor).collect():
        got.setdefault(x.g, {})[x.id] = x.v
    assert sum(got["g"].values()) == pytest.approx(100) and got["h"] == {1: 50.0, 2: 50.0}
    if floor:
        assert got["g"][2] == 5.0 and got["g"][3] / got["g"][1] == pytest.approx(149 / 50)
        # The floored negative does not count; what it took goes to the largest.
        assert got["n"][1] + got["n"][3] == pytest.approx(100)


def test_limits_hold_before_rescale(spark):
    shares = spark.createDataFrame([("m", i, str(i), 2020, s) for i, s in ((1, 60.0), (2, 30.0), (3, 10.0))], "market string, id long, name string, year int, market_share double")
    projected = spark.createDataFrame([("m", 1, "1", 2021, 5.0, 1), ("m", 2, "2", 2021, 90.0, 1), ("m", 3, "3", 2021, 5.0, 1)], "market string, id long, name string, year int, market_share double, tier int")
    limits = spark.createDataFrame([("m", 50.0, -40.0)], "market string, max_growth_rate double, min_growth_rate double")
    got = {x.id: x.market_share for x in sh.limit_growth(projected, shares, 1, limits).collect()}
    raw = {1: 60 * 0.6, 2: 30 * 1.5, 3: 10 * 0.6}
    assert got == pytest.approx({k: v / sum(raw.values()) * 100 for k, v in raw.items()})


def test_distribution_adds_up(spark, panel):
    clean = panel.where("value is not null and market = 'm'")
    world = fc.extend_total(clean.groupBy("market", "year").agg(F.sum("value").alias("value")), 6)
    edges = spark.createDataFrame([("Worldwide", "A"), ("Worldwide", "B"), ("A", "a"), ("A", "b"), ("B", "b"), ("B", "c")], "parent string, child string")
    out = sh.distribute(clean, world, 6, DistributionSettings(), regions=rg.leaves(edges)).cache()
    sums = out.where("region_type = 'entity'").groupBy("year").agg(F.sum("value").alias("s")).join(world, "year").collect()
    assert len(sums) == 9 and all(x.s == pytest.approx(x.value, abs=0.01) for x in sums)
    top = {x.year: x.value for x in out.where("name = 'Worldwide'").collect()}
    # b is reached twice and counts once.
    assert all(top[x.year] == pytest.approx(x.value, abs=0.01) for x in sums)


def test_region_cycle_is_refused(spark):
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "parent string, child string")
    assert {r.region for r in rg.cycles(loop).collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        rg.closure(loop)


def test_nested_definition(spark):
    got = rg.define(spark, {"World": {"North": ["a", "b"], "South": ["c"]}, "Pair": ["a", "c"]}).collect()
    assert ("North", "a") in {(x.parent, x.child) for x in got}
    assert {x.parent: x.region_id for x in got} == {"World": 90000, "North": 90001, "South": 90002, "Pair": 90003}


def test_fill_total_rules(spark):
    world = spark.createDataFrame([("m", 2000, 10.0), ("m", 2003, 40.0), ("m", 2004, 60.0)], "market string, year int, value double")
    years = spark.createDataFrame([("m", y) for y in (1998, 2001, 2006, 2030)], "market string, year int")
    got = {x.year: (x.value, x.rule) for x in sh.fill_total_series(world, years).collect()}
    assert got[2001] == (pytest.approx(20.0), "linear") and got[2006] == (pytest.approx(100.0), "trend")
    assert got[1998] == (pytest.approx(-10.0), "reverse_trend") and got[2030] == (pytest.approx(580.0), "trend")


def test_concentration(spark):
    v = np.array([5.0, 1.0, 3.0, 1.0])
    df = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "market string, id long, value double")
    got = rp.concentration(df, ["market"]).head()
    s = np.sort(v / v.sum())
    assert got.hhi == pytest.approx((s ** 2).sum() * 10000) and got.cr4 == pytest.approx(100)
    assert got.gini == pytest.approx(2 * (np.arange(1, 5) * s).sum() / 4 - 5 / 4)
