"""wardstat: cohort analytics for encounter tables, written on the Spark
DataFrame / SQL / ML APIs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so it need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
