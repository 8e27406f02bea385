"""Agent-session log analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Send the few Python helpers to executors by value, so that workers need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
