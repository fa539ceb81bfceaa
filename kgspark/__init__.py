"""kgspark: a PySpark-native engine for provenance-anchored knowledge graphs."""

import sys

from pyspark import cloudpickle

# Worker-side functions travel inside the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
