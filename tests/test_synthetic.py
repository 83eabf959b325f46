"""Fitted synthetic controls against the best of all supports, and their optimality over all controls."""

from itertools import combinations

import numpy as np
import pytest

from panelloom.operators import synthetic as sy
from panelloom.roles import DEFAULT, Roles

YEARS = [2000, 2001, 2002, 2003]


def best_error(points):
    """Least squared distance of the hull to the origin, over every set of rows whose affine minimum lies inside."""
    best = np.inf
    for k in range(1, points.shape[1] + 2):
        for own in combinations(range(len(points)), k):
            p = points[list(own)]
            system = np.block([[p @ p.T, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(system, np.array([0.0] * k + [1.0]), rcond=None)[0][:k]
            if (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-6:
                best = min(best, float(((w @ p) ** 2).sum()))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_nearest_in_hull(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(9, 4)) + rng.normal(size=4) * (seed % 4)
    points = np.vstack([points, points[:2]])  # repeated rows
    w = sy.nearest_in_hull(points, np.zeros(len(points)))
    assert (w >= 0).all() and w.sum() == pytest.approx(1)
    assert float(((w @ points) ** 2).sum()) == pytest.approx(best_error(points), abs=1e-8)
    again = sy.nearest_in_hull(points, w)
    assert float(((again @ points) ** 2).sum()) == pytest.approx(float(((w @ points) ** 2).sum()), abs=1e-10)


@pytest.fixture(scope="module")
def table():
    """Three markets: 40 controls, 3 controls of which one has a gap, and one without the treated entity."""
    rng = np.random.default_rng(3)
    rows = [("big", 0, y, 130.0 + 5 * i + float(rng.normal())) for i, y in enumerate(YEARS)]
    rows += [("big", j, y, float(100 + 10 * rng.normal() + (i + 1) * rng.normal())) for j in range(1, 41) for i, y in enumerate(YEARS)]
    rows += [("small", 0, y, v) for y, v in zip(YEARS, (10.0, 12.0, 14.0, 20.0))]
    rows += [("small", 1, y, v) for y, v in zip(YEARS, (8.0, 10.0, 12.0, 15.0))] + [("small", 2, y, v) for y, v in zip(YEARS, (12.0, 14.0, 16.0, 17.0))]
    rows += [("small", 3, 2000, 10.0), ("small", 3, 2001, None), ("small", 3, 2002, 14.0), ("small", 4, 2003, 9.0)]
    rows += [("none", 1, y, 5.0) for y in YEARS]
    return rows


def test_fitted_weights(spark, table):
    df = spark.createDataFrame(table, "market string, id long, year int, value double").repartition(5)
    parts = sy.fitted_control(df, 0, 2003)
    weights = [tuple(r) for r in parts["weights"].select("market", "id", "weight", "gap").collect()]
    assert {m for m, *_ in weights} == {"big", "small"}
    values = {(m, i, y): v for m, i, y, v in table}
    for m in ("big", "small"):
        own = {i: w for n, i, w, _ in weights if n == m}
        assert min(own.values()) > 0 and sum(own.values()) == pytest.approx(1) and len(own) <= 4
        ids = [i for i in sorted({i for n, i, *_ in table if n == m} - {0}) if all(values.get((m, i, y)) is not None for y in YEARS[:3])]
        points = np.array([[values[m, i, y] - values[m, 0, y] for y in YEARS[:3]] for i in ids])
        x = sum(w * points[ids.index(i)] for i, w in own.items())
        size = sum(values[m, 0, y] ** 2 for y in YEARS[:3])
        assert 2 * (x @ x - (points @ x).min()) <= sy.GAP * size * 1.01 + 1e-9  # no control leads nearer
        assert x @ x == pytest.approx(best_error(points), abs=1e-6 * size)
    small = {i: w for n, i, w, _ in weights if n == "small"}
    assert small == pytest.approx({1: 0.5, 2: 0.5})
    effect = {r["market"]: r for r in parts["effect"].collect()}
    assert effect["small"]["average_effect"] == pytest.approx(4.0) and effect["small"]["pre_r2"] == pytest.approx(1.0)


def test_one_market_and_empty(spark, table):
    one = [(i, y, v) for m, i, y, v in table if m == "small"]
    roles = Roles(by=())
    df = spark.createDataFrame(one, "id long, year int, value double")
    path = {r["year"]: r["effect"] for r in sy.fitted_control(df, 0, 2003, roles)["path"].collect()}
    assert path == pytest.approx({2000: 0.0, 2001: 0.0, 2002: 0.0, 2003: 4.0})
    assert sy.fitted_control(df, 77, 2003, roles)["weights"].count() == 0
    assert sy.fitted_control(df, 0, 1990, roles)["weights"].count() == 0
    assert sy.fitted_weights(spark.createDataFrame([], "market string, id long, year int, value double"), 0, 2003, DEFAULT).count() == 0
