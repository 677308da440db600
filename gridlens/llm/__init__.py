"""Operators of a training-data pipeline: text, URL, vector and chat tables."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: their machines need the libraries, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
