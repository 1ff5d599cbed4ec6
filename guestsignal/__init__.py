"""Review analytics as lazy Spark plans: entity x aspect x time x segment."""

import sys

from pyspark import cloudpickle

from guestsignal.config import Settings

# The few functions that run in Python workers travel with the plan, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
