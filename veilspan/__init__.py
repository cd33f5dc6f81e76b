"""veilspan: finding, scoring, redacting and monitoring personal data on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

#: Functions go to the executors by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
