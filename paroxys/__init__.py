"""Seizure-prediction analytics on Spark DataFrames.

Every public function takes and returns DataFrames (or Columns) and stays lazy
unless its docstring says otherwise.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
