"""Gram sums and the fits on them against plain loops over one key at a time."""

import datetime
import math
import random

import numpy as np
import pytest

from panelloom.operators import keyed_fits as kf

MONTH = [datetime.date(2000 + k // 12, k % 12 + 1, 1) for k in range(120)]


@pytest.fixture(scope="module")
def histories():
    """Histories by key: trend and season, random walk, autoregression, short ones, a constant, gaps, one value."""
    rng = random.Random(5)
    out = {}
    for k in range(12):
        n, level, last, own = rng.choice((40, 60, 90)), 100.0, 0.0, []
        for t in range(n):
            last = {0: 0.0, 1: last, 2: 0.7 * last}[k % 3] + rng.gauss(0, 3)
            own.append((MONTH[t], level + (0.5 * t + 5 * math.sin(t) if k % 3 == 0 else 0) + last))
        out[k] = [x for i, x in enumerate(own) if k != 4 or i % 5]
    out[20], out[21], out[22], out[23] = [(MONTH[0], 7.0)], [(MONTH[0], 7.0), (MONTH[1], 9.0)], [(MONTH[t], 3.0) for t in range(30)], [(MONTH[t], float(t * t)) for t in range(9)]
    return out


@pytest.fixture(scope="module")
def series(spark, histories):
    rows = [(k, d, v) for k, own in histories.items() for d, v in own] + [(30, MONTH[0], None)]
    return spark.createDataFrame(rows, "key long, date date, value double").repartition(3).cache()


def loop_adf(x, most):
    """Lags and t of the test, each regression fitted on its own."""
    step = np.diff(x)
    best = None
    rows = range(most, len(step))
    y = np.array([step[t] for t in rows])
    for lags in range(most + 1):
        if len(y) <= lags + 3:
            continue
        a = np.array([[1.0, x[t], *[step[t - k] for k in range(1, lags + 1)]] for t in rows])
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        sse = ((y - a @ b) ** 2).sum()
        if sse <= 1e-12 * (y @ y):
            return None
        score = len(y) * math.log(sse / len(y)) + 2 * (lags + 2)
        if best is None or score < best[0] - 1e-9:
            error = math.sqrt(sse / (len(y) - lags - 2) * np.linalg.inv(a.T @ a)[1, 1])
            best = (score, lags, b[1] / error)
    return best and best[1:]


def test_unit_root_lags_against_loops(series, histories):
    got = {r.key: r for r in kf.unit_root_lags(series, ["key"], "date", most_lags=4).collect()}
    assert set(got) == set(histories)
    for k, own in histories.items():
        want = loop_adf(np.array([v for _, v in own]), 4)
        if k < 20:
            assert got[k].lags == want[0] and got[k].t == pytest.approx(want[1], rel=1e-5)
            assert got[k].stationary == (want[1] < -2.86)
        elif len(own) < 8:
            assert got[k].t is None and not got[k].stationary


def loop_order(x, most):
    """Order and coefficients by solving the Yule-Walker equations of every order."""
    n, c = len(x), x - x.mean()
    gamma = np.array([(c[k:] * c[:n - k]).sum() / n for k in range(most + 1)])
    best = None
    for p in range(most + 1):
        phi = np.linalg.solve([[gamma[abs(i - j)] for j in range(p)] for i in range(p)], gamma[1:p + 1]) if p else np.zeros(0)
        v = gamma[0] - phi @ gamma[1:p + 1]
        if v > 0 and n - p - 2 > 0:
            score = n * math.log(v) + 2 * (p + 1) + 2 * (p + 1) * (p + 2) / (n - p - 2)
            if best is None or score < best[0] - 1e-9:
                best = (score, p, phi, v)
    return best


@pytest.mark.parametrize("d", [0, 1, 2])
def test_order_and_forecast_against_loops(spark, series, histories, d):
    orders = spark.createDataFrame([(k, d) for k in histories], "key long, d int")
    fits = {r.key: r for r in kf.select_order(series, orders, 4).collect()}
    out = {}
    for r in kf.autoregression(series, 5, orders=orders, most=4).collect():
        out.setdefault(r.key, {})[r.horizon] = r
    assert set(fits) == set(histories) == set(out) and all(sorted(x) == [1, 2, 3, 4, 5] for x in out.values())
    for k in range(12):
        values = np.array([v for _, v in histories[k]])
        x = np.diff(values, n=d)
        _, p, phi, v = loop_order(x, 4)
        assert fits[k].p == p and fits[k].variance == pytest.approx(v) and np.allclose(fits[k].phi, phi) and fits[k].reason is None
        path, mean = list(x), x.mean()
        for _ in range(5):
            path.append(mean + sum(a * (path[-i - 1] - mean) for i, a in enumerate(phi)))
        ahead = path[-5:]
        for _ in range(d):
            start = np.diff(values, n=d - 1)[-1] if _ == 0 and d > 1 else values[-1]
            ahead = list(start + np.cumsum(ahead))
        assert [out[k][h].value for h in range(1, 6)] == pytest.approx(ahead)
        assert out[k][1].date == MONTH[0].replace(year=histories[k][-1][0].year + histories[k][-1][0].month // 12, month=histories[k][-1][0].month % 12 + 1)
    assert fits[20].p == 0 and fits[20].reason and out[20][5].value is not None
    assert fits[22].p == 0 and out[22][3].value == pytest.approx(3.0)


def test_differencing_stops_where_the_test_passes(series, histories):
    got = {r.key: r.d for r in kf.differencing_order(series, 2, 2).collect()}
    for k in range(12):
        x = np.array([v for _, v in histories[k]])
        passed = [d for d in range(3) if loop_adf(np.diff(x, n=d), 2)[1] < -2.86]
        assert got[k] == (passed[0] if passed else 1)


def design(dates, u0, kind, degree, seasonal):
    rows = []
    for d in dates:
        u = (d.year - u0.year) + (d.month - u0.month) / 12
        rows.append([u ** p for p in range(1, (degree if kind == "polynomial" else 1) + 1)] + ([float(d.month == m) for m in range(2, 13)] if seasonal else []))
    return np.array(rows)


@pytest.mark.parametrize("kind, seasonal", [("linear", True), ("linear", False), ("polynomial", True), ("ridge", True)])
def test_regressions_against_loops(series, histories, kind, seasonal):
    out = {}
    for r in kf.keyed_regression(series, 4, kind=kind, degree=3, alpha=2.0, seasonal=seasonal).collect():
        out.setdefault(r.key, {})[r.horizon] = r
    assert set(out) == set(histories) and all(sorted(x) == [1, 2, 3, 4] for x in out.values())
    for k, own in histories.items():
        x, y = design([d for d, _ in own], own[0][0], kind, 3, seasonal), np.array([v for _, v in own])
        c, m = x - x.mean(axis=0), y - y.mean()
        if kind == "ridge":
            w = np.linalg.solve(c.T @ c + 2.0 * np.eye(c.shape[1]), c.T @ m)
        elif k >= 20 and k != 22:
            continue  # several solutions
        else:
            w = np.linalg.lstsq(c, m, rcond=None)[0]
        dates = [out[k][h].date for h in (1, 2, 3, 4)]
        want = y.mean() + (design(dates, own[0][0], kind, 3, seasonal) - x.mean(axis=0)) @ w
        assert [out[k][h].value for h in (1, 2, 3, 4)] == pytest.approx(np.maximum(want, 0), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("kind", ["lasso", "elasticnet"])
def test_sparse_regressions_meet_their_conditions(series, histories, kind):
    """At the minimum no coefficient can move: the gradient of the smooth part equals the penalty's slope, or is under it where the coefficient is 0."""
    alpha, share = 0.4, 1.0 if kind == "lasso" else 0.5
    got = {r.key: r.coefficients for r in kf.keyed_regression(series, 1, kind=kind, alpha=alpha, l1_ratio=0.5).collect()}
    zeros = 0
    for k in range(12):
        own = histories[k]
        x, y = design([d for d, _ in own], own[0][0], kind, 1, True), np.array([v for _, v in own])
        b, w = got[k][0], np.array(got[k][1:])
        rest = y - b - x @ w
        assert abs(rest.mean()) < 1e-6
        pull = x.T @ rest / len(y) - alpha * (1 - share) * w
        at = np.abs(w) > 1e-12
        zeros += (~at).sum()
        assert np.allclose(pull[at], alpha * share * np.sign(w[at]), atol=1e-4) and (np.abs(pull[~at]) <= alpha * share + 1e-4).all()
    assert zeros > 10


def test_lags_are_carried_ahead(series, histories):
    got = {(r.key, r.horizon): r for r in kf.keyed_regression(series, 3, kind="linear", seasonal=False, lags=(1, 3)).collect()}
    for k in range(12):
        own = histories[k]
        y = [v for _, v in own]
        u = design([d for d, _ in own], own[0][0], "linear", 1, False)[:, 0]
        a = np.array([[1.0, u[t], y[t - 1], y[t - 3]] for t in range(3, len(y))])
        b = np.linalg.lstsq(a, np.array(y[3:]), rcond=None)[0]
        assert np.allclose(got[k, 1].coefficients, b, rtol=1e-5, atol=1e-6)
        for h in (1, 2, 3):
            ahead = design([got[k, h].date], own[0][0], "linear", 1, False)[0, 0]
            y.append(b @ [1.0, ahead, y[-1], y[-3]])
            assert got[k, h].value == pytest.approx(max(y[-1], 0), rel=1e-5)
    assert all((k, h) in got for k in histories for h in (1, 2, 3))


@pytest.mark.parametrize("confounders", [[], ["a"], ["a", "b", "same"]])
def test_rolling_effects_against_loops(spark, confounders):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3):
        a, b = rng.normal(1000, 5, 30), rng.normal(size=30)
        t = a + b + rng.normal(size=30)
        y = 2 * t - a + rng.normal(size=30) if k < 2 else 2 * t
        rows += [(k, MONTH[i], *map(float, (t[i], y[i], a[i], b[i], 3 * a[i]))) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, date date, t double, y double, a double, b double, same double")
    got = {(r.key, r.date): r for r in kf.rolling_effects(df, "t", "y", confounders).collect()}
    assert len(got) == 3 * 18
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        for i in range(12, 30):
            z = np.array([[1.0, *[r[4 + "a b".split().index(c)] for c in confounders if c != "same"]] for r in own[i - 12:i]])
            t, y = (np.array([r[j] for r in own[i - 12:i]]) for j in (2, 3))
            t, y = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (t, y))
            r = got[k, MONTH[i]]
            assert r.effect == pytest.approx(t @ y / (t @ t), rel=1e-5) and r.correlation == pytest.approx(t @ y / math.sqrt((t @ t) * (y @ y)), rel=1e-5)
            assert 0 <= r.p_value <= 1 and (k < 2 or r.p_value < 1e-6)


def test_every_key_and_step_of_sparse_series(spark):
    """Keys of one row, with gaps, constant, at most a season long: every model has every step of each, and says where it could not."""
    from panelloom.operators import forecast as fc

    rows = [(1, MONTH[0], 5.0), (2, MONTH[0], 1.0), (2, MONTH[7], 4.0), (3, MONTH[3], 2.0), (3, MONTH[4], 2.0), (3, MONTH[5], 2.0)]
    rows += [(4, MONTH[t], float(t + 1)) for t in range(40) if t % 3] + [(5, MONTH[t], 10.0 + t % 12) for t in range(30)]
    sparse = spark.createDataFrame(rows, "key long, date date, value double")
    tables = {"smoothing": fc.complete(fc.exponential_smoothing(sparse, 4, kind="triple"), "exponential_smoothing", sparse, 4), "naive": fc.complete(fc.seasonal_naive(sparse, 4), "seasonal_naive", sparse, 4),
              "season": fc.complete(fc.autoregressive(sparse, 4, season=12), "autoregressive", sparse, 4), "pooled": fc.complete(fc.pooled(sparse, 4, learner="ridge"), "pooled", sparse, 4),
              "chosen": kf.autoregression(sparse, 4), "keyed": kf.keyed_regression(sparse, 4, kind="ridge")}
    for name, table in tables.items():
        got = table.collect()
        assert sorted((r.key, r.horizon) for r in got) == [(k, h) for k in range(1, 6) for h in range(1, 5)], name
        assert all(r.value is not None for r in got), name
        if "reason" in table.columns:
            assert {r.key for r in got if r.reason} >= {1}, name
    assert fc.fit_bass(sparse).count() == 5 and fc.every_key(fc.fit_curves(sparse, "logistic"), sparse, "sse", "none").count() == 5


def test_settings_by_dotted_paths(spark):
    from panelloom.roles import roles_from, setting, with_setting
    from panelloom.sources.readers import mapped

    config = {"a": {"b": {"c": 1}}, "column_mapping": {"t": {"id": "K", "value": "v", "by": "m"}}}
    assert setting(config, "a.b.c") == 1 and setting(config, "a.x.c", 5) == 5 and setting(config, "a.b.c.d", None) is None
    changed = with_setting(with_setting(config, "a.b.c", 2), "new.level", 3)
    assert (setting(changed, "a.b.c"), setting(changed, "new.level"), setting(config, "a.b.c")) == (2, 3, 1)
    assert roles_from(config, "t").entity == ["m", "K"] and roles_from(config, "none") .id == "id"
    df = spark.createDataFrame([(1, 2.0, "x")], "k long, V double, other string")
    only = {"column_mapping": {"t": {"id": "K", "value": "v"}}}
    assert mapped(df, only, "t").columns == ["id", "value", "other"] and mapped(df, only, "unknown").columns == df.columns
    for bad in ({"id": "absent"}, {"id": "k", "value": "K"}, {"other": "k"}):
        with pytest.raises(ValueError):
            mapped(df, {"column_mapping": {"t": bad}}, "t")
