"""A PySpark engine for point-in-time market-structure analytics."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with the job, so that they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
