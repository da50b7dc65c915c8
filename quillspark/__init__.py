"""Corpus curation and evaluation operators expressed as Spark DataFrame plans.

Python functions travel to executors by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
