"""Sentence-pair corpus preparation and scoring as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with the jobs that use them,
# so that the package need only be installed where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
