"""blockloom: content-addressed data processing expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Python workers needn't have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
