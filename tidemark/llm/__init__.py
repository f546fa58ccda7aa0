"""Operators for preparing training corpora: mixing, filtering, deduplication, scoring, packing, extraction.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
