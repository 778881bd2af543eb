"""Daily time-series features and econometric diagnostics as Spark jobs."""

import sys

from pyspark import cloudpickle

from dayloom.session import build_session, configure

# Functions of this package travel to Python workers by value, so executors do
# not need it installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]
