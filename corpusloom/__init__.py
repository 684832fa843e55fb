"""Corpus preparation, auditing and evaluation as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions go to the workers by value, so the package need not be installed there
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
