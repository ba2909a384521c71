"""Operators for preparing language-model training text.

Nothing outside this package imports it.  ``registry`` lists the queries and
their SQL; ``__spark_entry__`` adds them when this package is present.

Functions of this package travel to executors by value, so they need not have it
installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
