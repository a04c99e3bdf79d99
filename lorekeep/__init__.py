"""lorekeep: retrieval over chat logs and textbooks, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

from lorekeep.session import checkpoint_dir, get_session

# What runs in Python workers travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpoint_dir", "get_session"]
