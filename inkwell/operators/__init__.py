"""Operators over DataFrames; each takes explicit key columns."""

import sys

from pyspark import cloudpickle

# Functions of these modules that run in tasks travel with their code, so executors need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
