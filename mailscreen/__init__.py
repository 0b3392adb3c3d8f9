"""Spam/ham text screening on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from mailscreen.config import ScreeningConfig, SplitFractions

__all__ = ["ScreeningConfig", "SplitFractions"]

# The few functions that run in Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
