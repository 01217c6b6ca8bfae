"""Operators for preparing training text at scale.

One module per operator; ``queries`` registers one query for each of them.
Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
