"""Top-down repair in waves against one region after the other."""

import random

import pytest

from panelloom.operators import regions as rg


def serial(values, targets, order, leaves):
    out = dict(values)
    for name in order:
        own = [k for k in out if k[1] in leaves[name]]
        for year in {y for y, _ in own}:
            mine = [k for k in own if k[0] == year]
            if (year, name) in targets:
                t, s = targets[year, name], sum(out[k] for k in mine)
                size = max(t, s)
                if abs(t - s) > (size * 0.0001 if size > 1000 else 0.01):
                    for k in mine:
                        out[k] = t / len(mine) if s == 0 else out[k] * t / s
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_waves_equal_one_region_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = [f"e{i}" for i in range(14)]
    leaves = {f"r{i}": set(rng.sample(names, rng.randrange(1, 5))) for i in range(7)} | {"all": set(names)}
    order = rng.sample(sorted(leaves), len(leaves))
    values = {(y, n): 0.0 if n == "e3" else rng.uniform(1, 900) for y in (2000, 2001) for n in names if rng.random() < 0.9}
    targets = {(y, r): rng.uniform(10, 4000) for y in (2000, 2001) for r in leaves if rng.random() < 0.9}
    entities = spark.createDataFrame([("m", y, n, v) for (y, n), v in values.items()], "market string, year int, name string, value double")
    regions = spark.createDataFrame([("m", y, r, v) for (y, r), v in targets.items()], "market string, year int, name string, value double")
    table = spark.createDataFrame([(r, x) for r, own in leaves.items() for x in own], "region string, leaf string")
    got = {(r.year, r.name): r.value for r in rg.repair_top_down(regions, entities, order, table).collect()}
    assert got == pytest.approx(serial(values, targets, order, leaves))
    waves = {r.region: r.wave for r in rg.repair_waves(order, table).collect()}
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if leaves[a] & leaves[b]:
                assert waves[a] < waves[b]


def test_many_disjoint_regions_are_one_wave(spark):
    table = spark.createDataFrame([(f"r{i // 2}", f"e{i}") for i in range(400)] + [("all", f"e{i}") for i in range(400)], "region string, leaf string")
    waves = rg.repair_waves([f"r{i}" for i in range(200)] + ["all"], table)
    assert sorted({(r.wave) for r in waves.collect()}) == [0, 1] and waves.where("region = 'all'").first().wave == 1
    assert rg.repair_top_down(table, table, [], table) is table
