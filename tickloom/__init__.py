"""Event-level market-data analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel inside the tasks that use them, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
