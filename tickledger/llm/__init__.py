"""Operators for preparing training data. Nothing else in the package imports this part."""

import sys

from pyspark import cloudpickle

import tickledger.session
from tickledger.operators import skew

# The functions run in Python workers that need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(tickledger.session)
cloudpickle.register_pickle_by_value(skew)
