"""Training-data operators: language ID, search, deduplication, fixity, mixing, redaction, decontamination, sharding.

Nothing outside this subpackage imports it. ``registry`` holds the thin queries over the given tables.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
