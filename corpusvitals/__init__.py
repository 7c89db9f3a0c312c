"""Health analytics for many source trees at once, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
