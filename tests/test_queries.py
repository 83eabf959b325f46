"""Registered queries against their SQL twin on the smallest tables. PANELLOOM_ALL=1 runs every query, else each fifth."""

import os

import oracle
import pytest

from panelloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
PICKED = NAMES if os.environ.get("PANELLOOM_ALL") else [n for n in NAMES[::5]] + ["d21_distribute", "s01_stream_accuracy", "h05_kendall"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(PICKED)))
def test_query(spark, con, name):
    _, rows, problem = oracle.check(name, spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert problem is None
    assert rows >= 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not any(n.startswith("op") or "pipeline" in n for n in QUERIES)
