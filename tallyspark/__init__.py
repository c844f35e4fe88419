"""Spark-native analytics over governed metrics and training-corpus operators.

Functions that run in Python workers are shipped by value, so executors need nothing of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
