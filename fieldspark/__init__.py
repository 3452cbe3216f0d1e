"""Points, labelled grids, trajectories and graphs as DataFrame operators, and operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions that Spark sends to executors carry the library's code with them, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
