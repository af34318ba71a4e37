"""Training-data operators: deduplication, sharding, mixing, language, tokens and exact search."""

from pyspark import cloudpickle as _pickle

# Functions of this package travel to the executors by value, so the package need not be installed there.
import marketlens.llm as _self

_pickle.register_pickle_by_value(_self)
