"""docketry: brief, citation and quotation analytics as Spark DataFrame operators.

Functions of this package travel to Python workers by value, so executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
