"""helixmill: sequence-library analytics and training-data operators as Spark jobs.

Functions sent to the executors carry their own code, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
