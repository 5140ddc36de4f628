"""webcorpus: DataFrame operators over stored web pages, snapshots and outcome logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
