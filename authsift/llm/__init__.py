"""Training-data operators: the corpus operators and their registered queries.

The package's functions are sent to the Python workers by value, so executors
need no copy of the package on their path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
