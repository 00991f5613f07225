"""spindrift: a PySpark-native engine for code-corpus, retrieval and evaluation workloads."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel by value, so a cluster's executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
