"""Training-data operators: quality, deduplication, privacy, secrets, decontamination, mixing, archives."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
