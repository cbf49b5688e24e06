"""Operators of a training-data pipeline over documents, pages, vectors and conversations.

The functions that run in Python workers travel by value, so that executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
