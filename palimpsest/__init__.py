"""Spark-native analytics for short sequencing reads and text corpora.

Functions that run in Python workers are pickled by value, so a cluster needs no copy of this
package on its executors.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
