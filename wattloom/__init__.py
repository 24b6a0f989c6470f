"""Wattloom: endurance-ride analytics and record processing on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
