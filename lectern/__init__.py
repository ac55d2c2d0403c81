"""Retrieval, ingestion and training-data operators as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Tasks get the library's own functions with their code, so executors needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
