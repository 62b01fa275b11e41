"""Operators for preparing training text: classifiers, joins, dedup, mixing, sharding.

Nothing outside this subpackage imports it; ``queries`` registers one query
per operator for the driver entry module.
"""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
