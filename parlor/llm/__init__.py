"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# The functions that run in Python tasks travel with the tasks: executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
