"""Corpus analytics on Spark: relational, lexical and data-quality operators over ordered text units."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so a cluster needs no copy of it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
