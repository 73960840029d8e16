"""threadlens: discussion-corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python code that runs in tasks travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
