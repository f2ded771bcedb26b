"""Operators of a training-data pipeline over documents, pages, embeddings and conversations.

Functions of this package that run in Python workers are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
