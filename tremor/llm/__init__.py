"""Operators for preparing training data: extraction, quality, mixing, licences,
chat formatting, token counts, deduplication, packing and fingerprints.

Nothing outside this subpackage imports it.  Functions that run in Python workers
are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
