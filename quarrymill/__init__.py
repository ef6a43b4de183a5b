"""Spark-native dataset curation: every operator is a function from DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# Functions of this package go to Python tasks by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
