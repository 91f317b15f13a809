"""Pacelake: analytics over repeated, partly contradictory observations, as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors by value, so that the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
