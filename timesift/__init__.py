"""timesift: timed-evidence analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Steps and UDFs travel to the executors by value, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
