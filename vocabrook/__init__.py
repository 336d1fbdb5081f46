"""Vocabrook: Spark-first entity grounding, dictionary annotation and corpus work."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the package's functions with the plan, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
