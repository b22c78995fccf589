"""Operators of a training-data pipeline. Nothing outside this package imports it.

Functions that run in Python workers are sent by value, so executors need no
copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
