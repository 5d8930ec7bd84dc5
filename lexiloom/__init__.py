"""Concept and term extraction from text corpora, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, which so need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
