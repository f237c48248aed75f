"""tarnloom: a PySpark-native engine for curating captioned-clip and text corpora.

``sources`` reads and writes tables, ``functions`` holds Column -> Column
expressions, ``operators`` DataFrame -> DataFrame operators, ``plans`` named
queries with their SQL twins, and ``streaming`` the incremental forms.  The
training-data operators live in the optional subpackage ``llm``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
