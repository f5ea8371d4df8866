"""Keep a data estate recoverable: snapshot, match, copy, rewrite and plan, all as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task helpers travel inside the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
