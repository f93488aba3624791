"""Operators of a training-data pipeline: dedup, language, URL, toxicity, quality, packing, search, sharding.

Nothing outside this subpackage imports it.  Functions that run inside Spark tasks travel to the Python workers by
value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
