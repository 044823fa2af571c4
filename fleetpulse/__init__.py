"""Condition monitoring and prognostics for machine fleets, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package with them, so a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
