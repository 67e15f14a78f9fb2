"""Authenticated, versioned key-value analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
