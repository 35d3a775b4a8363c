"""Document pages, corpora and training data as ordinary Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors don't need it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
