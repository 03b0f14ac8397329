"""Driving-log analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
