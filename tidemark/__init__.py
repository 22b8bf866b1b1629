"""Ordered, versioned key-value analytics expressed as Spark DataFrame, SQL and Structured Streaming plans.

Functions for executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
