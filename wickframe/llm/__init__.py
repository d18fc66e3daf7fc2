"""Training-data operators: text, conversation and vector tables at corpus scale.

Nothing outside this subpackage imports it.  Functions that run in Python workers are shipped by value, so
executors need the third-party libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
