"""Technical analysis, feature engineering and model monitoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors with the task, so these need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
