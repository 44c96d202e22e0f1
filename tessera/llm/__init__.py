"""Training-data operators; nothing else in tessera imports this package.

Functions sent to executors are pickled by value, so executors need only the
third-party libraries and not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
