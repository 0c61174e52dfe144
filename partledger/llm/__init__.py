"""Operators for preparing training text at corpus scale."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so workers need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
