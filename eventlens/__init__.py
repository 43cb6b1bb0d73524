"""Spark-native analytics over document and news streams."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Python helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
