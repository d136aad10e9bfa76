"""Operators of a large-scale training-data pipeline.

One module per operator, each with a general interface; ``queries`` holds the thin
``opN_*`` queries that apply them to the driver tables. Nothing outside this package
imports it. Functions that run in Python workers are shipped by value, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
