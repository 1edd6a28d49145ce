"""Operators of a large-scale training-data pipeline.

One module per operator, each with a general interface of its own; the thin
``opN_*`` queries that bind an operator to the driver's tables are in
``queries.py`` and their DuckDB twins in ``oracle.py``.  Nothing else in the
library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors with the job, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
