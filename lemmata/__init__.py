"""lemmata: mathematical-document analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Worker processes need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
