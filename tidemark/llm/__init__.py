"""Operators for preparing training data. Nothing else in the library imports this subpackage.

The functions that run on executors are shipped by value, so a cluster needs no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
