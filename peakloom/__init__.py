"""Chromatography and mass-spectrum analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
