"""Operators for preparing text corpora that train language models.

Nothing else in the library imports this subpackage.  Its Python functions are
shipped to workers by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
