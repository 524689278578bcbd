"""parcelspark: Spark-native processing of cadastral exchange data and of training corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code with them, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
