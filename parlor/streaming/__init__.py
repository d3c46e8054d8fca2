"""Structured Streaming twins of the stateful operators."""

import sys

from pyspark import cloudpickle

# Processors travel with their query: executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
