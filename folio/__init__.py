"""Reading-corpus analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
