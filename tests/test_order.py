"""Distributed ranks, quantiles and rank correlations against brute force, with buckets small enough to split every group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import order, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    # One group holds most rows, one value holds a third of that group.
    hot = np.where(rng.random(3000) < 0.33, 7.0, rng.normal(size=3000).round(3))
    pdf = pd.concat([pd.DataFrame({"g": "hot", "v": hot}), pd.DataFrame({"g": "cold", "v": rng.normal(size=40).round(1)}), pd.DataFrame({"g": "one", "v": [3.0]})], ignore_index=True)
    pdf["i"] = range(len(pdf))
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("per_bucket", [20, 50_000])
def test_positions(skewed, per_bucket):
    df, pdf = skewed
    got = order.positions(df, ["g"], F.col("v"), per_bucket).toPandas()
    want = pdf.groupby(["g", "v"]).size().rename("n").reset_index()
    want["below"] = want.groupby("g")["n"].cumsum() - want["n"]
    both = got.merge(want, left_on=["g", "_key"], right_on=["g", "v"])
    assert len(both) == len(want) == len(got)
    assert (both["_n"] == both["n"]).all() and (both["_below"] == both["below"]).all()
    assert (both.groupby("g")["_distinct_below"].max() == want.groupby("g").size() - 1).all()
    assert (got.groupby("g")["_total"].max() == pdf.groupby("g").size()).all()


def test_buckets_split_the_hot_group(skewed):
    df, _ = skewed
    plan = order.positions(df, ["g"], F.col("v"), 20)
    assert "Window" in plan._jdf.queryExecution().toString()
    counts = df.groupBy("g").agg(F.countDistinct("v").alias("d")).toPandas()
    assert counts.d.max() > 20 * 10


def test_quantiles(skewed):
    df, pdf = skewed
    got = order.quantiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q99": 0.99}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["q1", "q5", "q99"]].astype(float), np.quantile(part.v, [0.1, 0.5, 0.99]))


def test_ranks(skewed):
    df, pdf = skewed
    got = order.with_ranks(df, ["g"], F.col("v"), rank="r", dense="d", average="a").toPandas().sort_values("i")
    by = pdf.groupby("g")["v"]
    assert (got.r.to_numpy() == by.rank("min").to_numpy()).all()
    assert (got.d.to_numpy() == by.rank("dense").to_numpy()).all()
    assert (got.a.to_numpy() == by.rank().to_numpy()).all()


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert order.quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0


def brute_tau(x, y):
    s = tx = ty = n = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty, n = s + a * b, tx + (a == 0), ty + (b == 0), n + 1
    return s / np.sqrt((n - tx) * (n - ty))


def test_kendall_and_spearman(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 33, "x": rng.integers(0, 12, 93).astype(float), "y": rng.integers(0, 9, 93).astype(float)})
    df = spark.createDataFrame(pdf)
    tau = stats.kendall(df, ["g"], "x", "y").toPandas().set_index("g").kendall
    rho = stats.spearman(df, ["g"], "x", "y").toPandas().set_index("g").spearman
    for g, p in pdf.groupby("g"):
        assert tau[g] == pytest.approx(brute_tau(p.x.to_numpy(), p.y.to_numpy()), abs=1e-12)
        assert rho[g] == pytest.approx(np.corrcoef(p.x.rank(), p.y.rank())[0, 1], abs=1e-12)


def test_student_t():
    # Known two-sided 5 % points of Student's t.
    for df, t in ((1, 12.706205), (3, 3.182446), (10, 2.228139), (100, 1.983972)):
        assert stats.critical_t(0.05, df) == pytest.approx(t, abs=1e-5)
        assert stats.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(0.05, abs=1e-6)
