"""Offline, cost-aware evaluation of model-routing policies on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
