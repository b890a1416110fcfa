"""Order-form analytics as DataFrame operators and Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers are shipped by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
