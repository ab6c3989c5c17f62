"""Series, text and pattern analytics as plain Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import cloudpickle

# The few solver functions that run in Python workers travel with their code, so
# executors need not have this package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
