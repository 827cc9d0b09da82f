"""Operators of a training-data pipeline.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Workers
get its functions by value, so the package need not be installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
