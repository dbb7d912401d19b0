"""Document-corpus analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python steps travel to executors inside the job, so workers need no copy of
# the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
