"""A PySpark-native engine for conversation exports and training-data corpora."""

import sys

from pyspark import cloudpickle

# What runs on executors travels with the plan: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
