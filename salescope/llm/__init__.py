"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_<name>`` queries over the driver's tables.  Nothing outside this
subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this package with their job, so executors need no
# copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
