"""Lodestone: DataFrame jobs for the data side of retrieval-augmented language models."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
