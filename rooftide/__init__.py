"""Rooftide: a Spark-native analytics engine for fragmented listings markets."""

import sys

from pyspark import cloudpickle

# Worker processes get this package's functions by value, so that they need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
