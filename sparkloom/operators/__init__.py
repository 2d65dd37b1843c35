"""See the modules of this folder."""

import sys

from pyspark import cloudpickle

# what runs in Python workers is pickled by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
