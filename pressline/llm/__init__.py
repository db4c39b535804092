"""Operators for training-data pipelines. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions by value: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
