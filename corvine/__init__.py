"""corvine: document analytics and hybrid retrieval expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
