"""Document-archive analytics on Spark: lazy DataFrame operators, functions, sources, plans and streams."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so a cluster needs no copy of it on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
