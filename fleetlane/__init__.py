"""fleetlane: vehicle-tracking analytics and training-data operators on Spark.

Python functions that Spark sends to its executors are pickled by value, so executors need no copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
