"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  The modules are pickled by value, so
executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
