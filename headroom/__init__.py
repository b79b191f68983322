"""Forecast and capacity analytics as Spark DataFrame operators.

Functions of this package that run inside tasks travel with the job, so executors need
no copy of it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
