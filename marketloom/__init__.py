"""Labour-market analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel whole, so these need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
