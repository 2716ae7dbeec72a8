"""Training-data operators on Spark tables of documents and pages.

Task code of this subpackage travels by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
