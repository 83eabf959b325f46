"""Rolling-origin stacking against refits of every origin."""

import datetime
import math

import numpy as np
import pytest

from panelloom.operators import stacking as st

H = 3


def month(k):
    return datetime.date(2000 + k // 12, k % 12 + 1, 1)


@pytest.fixture(scope="module")
def histories():
    rng = np.random.default_rng(4)
    out = {1: {t: 100 + 3.0 * t + float(rng.normal()) for t in range(40)}, 2: {t: float(50 * math.exp(0.05 * t) + rng.normal()) for t in range(30)},
           3: {t: float(abs(rng.normal()) * 40 + 1) for t in range(36) if t % 7}, 4: {0: 5.0, 1: 6.0}, 5: {t: 9.0 for t in range(20)}, 6: {t: float(t - 3) for t in range(25)}, 7: {3: 2.0}}
    return out


@pytest.fixture(scope="module")
def series(spark, histories):
    rows = [(k, month(t), v) for k, own in histories.items() for t, v in own.items()] + [(1, month(50), None), (1, month(51), float("nan")), (8, month(1), None)]
    return spark.createDataFrame(rows, "key long, date date, value double").repartition(3).cache()


def members(own, upto, h):
    """The three forecasts of period upto + h from the periods up to ``upto``, each fitted on its own."""
    first = min(own)
    x, v = np.array([t - first for t in own if t <= upto], float), np.array([own[t] for t in own if t <= upto])
    at = upto + h - first
    line = max(float(np.polyval(np.polyfit(x, v, 1), at)), 0.0) if len(x) > 1 else None
    grown = None
    if v.min() > 0 and len(x) > 1:
        grown = min(math.exp(min(float(np.polyval(np.polyfit(x, np.log(v), 1), at)), 700.0)), 10 * v.max())
    return [line, grown, own[upto]]


def filled(m):
    mean = np.mean([p for p in m if p is not None])
    return [mean if p is None else p for p in m]


def test_pairs(series, histories):
    got = {(r["key"], r["origin"], r["horizon"]): r for r in st.rolling_pairs(series, H).collect()}
    want = {}
    for k, own in histories.items():
        for n, t in enumerate(sorted(own), 1):
            for h in range(1, H + 1):
                if n >= st.LEAST_ROWS and t + h in own:
                    want[k, month(t), h] = [*members(own, t, h), own[t + h]]
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [got[k][c] for c in (*st.MEMBERS, "actual")] == [pytest.approx(x, rel=1e-7, abs=1e-7) if x is not None else None for x in w]
        assert got[k]["date"] > got[k]["origin"]


def test_stacking(series, histories):
    got = {(r["key"], r["horizon"]): r for r in st.rolling_stacking(series, H).collect()}
    assert got.keys() == {(k, h) for k in histories for h in range(1, H + 1)}  # every key, every step
    for k, own in histories.items():
        rows = [(filled(members(own, t, h)), own[t + h]) for n, t in enumerate(sorted(own), 1) for h in range(1, H + 1) if n >= st.LEAST_ROWS and t + h in own]
        last = max(own)
        for h in range(1, H + 1):
            r, p = got[k, h], np.array(filled(members(own, last, h)))
            assert r["date"] == month(last + h) and r["pairs"] == len(rows)
            w, start = np.full(3, 1 / 3), 0.0
            if len(rows) >= st.LEAST_PAIRS:
                x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
                c = np.cov(x.T, bias=True)
                right = ((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0)
                w = w + np.linalg.solve(c + max(st.PULL * np.trace(c) / 3, 1e-9) * np.eye(3), right - c.sum(1) / 3)
                start = y.mean() - w @ x.mean(0)
            assert r["reason"] == (None if len(rows) >= st.LEAST_PAIRS else "too few pairs")
            assert r["value"] == pytest.approx(max(start + w @ p, 0.0), rel=1e-4, abs=1e-4)


def test_empty(series):
    assert st.rolling_stacking(series.limit(0), H).count() == 0
