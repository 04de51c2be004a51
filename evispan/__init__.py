"""Evidence retrieval and research bookkeeping over DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
