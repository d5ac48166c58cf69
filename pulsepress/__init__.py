"""Article and social-signal analytics on Spark."""

import sys

from pyspark import cloudpickle

from pulsepress.store import ArticleStore, VectorItemStore

__all__ = ["ArticleStore", "VectorItemStore"]

# Functions of this package travel with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
