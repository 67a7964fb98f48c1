"""Rule-driven event processing on Spark DataFrames.

Functions of this package travel to the Python workers by value, so the executors need no
copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
