"""Operators and a pipeline for large text corpora; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so the workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
