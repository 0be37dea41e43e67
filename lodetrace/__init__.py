"""lodetrace: supply-chain analytics and training-data preparation on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# functions shipped to Python workers travel whole, so executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
