"""Training-data operators over the corpus tables (documents, pages, labels)."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster
# needs nothing but PySpark and numpy on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
