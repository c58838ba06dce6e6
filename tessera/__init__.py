"""Tessera: PySpark operators for tables of grouped model outputs and their judgments."""

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster needs no copy of the
# package on its workers' import path.
cloudpickle.register_pickle_by_value(__import__(__name__))
