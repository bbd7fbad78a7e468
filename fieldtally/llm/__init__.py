"""Operators for preparing training data, on whole corpora.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers travel as code, so workers need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
