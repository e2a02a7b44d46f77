"""Panel, daily-series and evidence-table analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# the vectorised kernels travel with the query, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
