"""Operators for training-data pipelines. Nothing outside this package imports it, except the entry files.

Functions of this package that run on executors travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
