"""Impact analytics on Spark: clean, model, predict with and without an event, summarise."""

import sys

from pyspark import cloudpickle

# Functions that run on workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
