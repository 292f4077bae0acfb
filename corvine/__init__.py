"""Corvine: a Spark-native engine for building, searching and judging text and code corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
