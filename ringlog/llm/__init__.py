"""Operators for preparing training data, and the queries that apply them."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
