"""Keyed market-share forecasting, distribution and panel analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
