"""Training-data operators: deduplication, archives, privacy, quality, scoring, search, packing, mixing.

Nothing outside this subpackage imports it. Functions shipped to Python
workers travel by value, so executors need no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
