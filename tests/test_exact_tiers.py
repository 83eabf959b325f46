"""Exact tiers of shares against every partition of small markets."""

from itertools import combinations

import numpy as np
import pytest

from panelloom.operators import tiers as tr
from panelloom.roles import Roles


def runs(u, n, cuts):
    return [np.repeat(u[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]


def error(parts):
    return sum(float(((p - p.mean()) ** 2).sum()) for p in parts)


def silhouette(parts):
    out = []
    for i, own in enumerate(parts):
        for j, x in enumerate(own):
            if len(own) == 1:
                out.append(0.0)
                continue
            a = ((np.delete(own, j) - x) ** 2).mean()
            b = min(((q - x) ** 2).mean() for h, q in enumerate(parts) if h != i)
            out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("seed", range(8))
def test_partitions(seed):
    rng = np.random.default_rng(seed)
    u = np.sort(rng.choice(500, size=9, replace=False)).astype(float)
    n = rng.integers(1, 4, size=9)
    found = tr._partitions(u, n, 9)
    for k in range(1, 10):
        cuts = found[k - 1]
        best = min(error(runs(u, n, [0, *inner, 9])) for inner in combinations(range(1, 9), k - 1))
        assert len(cuts) == k + 1 and error(runs(u, n, cuts)) == pytest.approx(best)
        e, s = tr._scores(u, n, cuts)
        assert e == pytest.approx(best, abs=1e-6)
        assert s == (pytest.approx(silhouette(runs(u, n, cuts))) if k > 1 else None)


def test_exact_tiers(spark):
    rows = [("three", i, s) for i, s in enumerate([30.0, 31.0, 10.0, 10.5, 11.0, 2.5, 2.5, 2.5])] + [("solo", 1, 100.0)] + [("pair", 1, 50.0), ("pair", 2, 50.0), ("pair", 3, None), ("pair", 4, float("nan"))] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "market string, id long, market_share double").repartition(3)
    got = {(r["market"], r["tier"]): r for r in tr.exact_tiers(df).collect()}
    assert {m: r["k"] for (m, _), r in got.items()} == {"three": 3, "solo": 1, "pair": 1}
    three = [tuple(round(x, 6) for x in (got["three", t]["low"], got["three", t]["high"], got["three", t]["entities"], got["three", t]["threshold"])) for t in (1, 2, 3)]
    assert three == [(30.0, 31.0, 2, 30.0), (10.0, 11.0, 3, 5.0), (2.5, 2.5, 3, 0.75)]
    assert got["pair", 1]["entities"] == 2 and got["solo", 1]["threshold"] == 100.0
    one = tr.exact_tiers(df.where("market = 'three'").drop("market"), roles=Roles(by=()))
    assert one.count() == 3
    assert tr.exact_tiers(df.limit(0)).count() == 0


def test_distinct_shares_of_a_market_are_few(spark):
    """A hundred thousand entities, a few hundred distinct shares."""
    shares = spark.range(100000).selectExpr("'m' AS market", "id", "pow(id + 1, -0.8) AS s")
    total = shares.selectExpr("sum(s)").first()[0]
    fits = tr.exact_partitions(shares.selectExpr("market", "id", f"s / {total} * 100 AS market_share"), range(2, 6)).collect()
    assert [r["k"] for r in sorted(fits, key=lambda r: r["k"])] == [2, 3, 4, 5]
    assert all(sum(t["entities"] for t in r["tiers"]) == 100000 for r in fits)
