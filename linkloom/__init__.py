"""Entity resolution and record linkage as DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
