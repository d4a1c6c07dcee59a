"""Run analytics on Spark DataFrames: spectra, projections, features, ranking, model comparison."""

import sys

from pyspark import cloudpickle

# Helpers used inside Python tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
