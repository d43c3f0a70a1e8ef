"""Operators on training data. Functions that run in tasks travel to the executors by value, so
that a cluster needs the public libraries alone and no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
