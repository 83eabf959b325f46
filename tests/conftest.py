import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from panelloom.functions import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = oracle.session()
    yield s
    session.release(s)
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Two markets; entity 3 misses a year and has a null, entity 9 is alone in its market."""
    rows = [("m", 1, "a", 2018, 100.0), ("m", 1, "a", 2019, 110.0), ("m", 1, "a", 2020, 130.0), ("m", 2, "b", 2018, 80.0), ("m", 2, "b", 2019, 85.0), ("m", 2, "b", 2020, 70.0),
            ("m", 3, "c", 2018, 90.0), ("m", 3, "c", 2020, None), ("solo", 9, "z", 2019, 5.0), ("solo", 9, "z", 2020, 6.0)]
    return spark.createDataFrame(rows, "market string, id long, name string, year int, value double")
