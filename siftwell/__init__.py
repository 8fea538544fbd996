"""Spark-native analytics: event discovery queries and training-data operators.

Functions of this package travel to the executors by value, so these need only Spark and the installed libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
