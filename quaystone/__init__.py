"""Spark-native document verification and corpus preparation.

Functions that run inside Python workers are pickled by value, so a driver
that imported this package from a checkout does not need it installed on the
executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
