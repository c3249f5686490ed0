"""Training-data operators: one module per operator, ``queries`` registers them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so these need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
