"""Operations for building language-model training corpora.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it is present.
"""

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster
# needs no copy of the package on its workers' import path.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
