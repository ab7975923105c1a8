"""Operators for preparing training text.

Functions of this package travel to Python workers by value, so executors need no copy of it.
"""

import simlens
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(simlens)
