"""glyphmill: PySpark jobs that prepare and judge text-to-diagram data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so workers need
# no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
