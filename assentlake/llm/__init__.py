"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Workers need not have the package installed: its functions travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
