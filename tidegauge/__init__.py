"""tidegauge: windowed monitoring features, forecasting and screening on Spark."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so executors on other
# machines need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
