"""Corpus operators for training data; nothing else in the library imports them.

Functions that run on executors are shipped by value, so executors need only
the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
