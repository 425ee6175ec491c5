"""Operators for preparing large text corpora (deduplication, scans, scoring).

Python functions of this subpackage travel to the executors by value, so a
worker needs no copy of the package on its import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
