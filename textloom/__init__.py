"""textloom: curation, code metrics, evaluation and training-data preparation as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Executors needn't have the package: what a task runs is sent with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
