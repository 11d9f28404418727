"""Operators for building training corpora: sharding, deduplication, search, scoring, mixing.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Executors receive the functions of this subpackage by value, so that they need not be able to import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
