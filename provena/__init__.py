"""Corpus building, retrieval and answer evaluation as Spark DataFrame jobs.

Functions of this package travel to executors by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
