"""chatlake: a PySpark-native analytics engine for conversational-support data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers that run inside tasks travel with the task, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
