"""Event-time market observation and evidence analytics on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _pickle

# Functions of this package travel to the executors by value, so the package need not be installed there.
_pickle.register_pickle_by_value(_sys.modules[__name__])
