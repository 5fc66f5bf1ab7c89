"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this subpackage travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
