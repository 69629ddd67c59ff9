"""skein: script and page analytics on Spark, built from DataFrame plans.

Functions that run in Python workers travel with their code, so executors
need no copy of this package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
