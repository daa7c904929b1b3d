
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Spark's Python workers travel by value,
# so the executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
