"""kmerloom: sequence, k-mer and sequence-graph analytics as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
