"""Event analytics on Spark: windows, event time, sketches, rollups, changelogs, joins, top-K, recovery."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
