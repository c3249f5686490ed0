"""cobi: spectral co-clustering of bipartite graphs built from tables, on Spark.

Two tables joined on a correlated key become a weighted bipartite graph
(value of a column in table A  x  value of a column in table B); the graph is
degree-normalised, a truncated SVD is taken by distributed block Krylov iteration,
and k-means groups both sides at once.  Everything node- or edge-sized stays in
DataFrames; the driver only sees b x b Gram matrices and k centres.
"""

import sys

from pyspark import cloudpickle

from cobi.session import ensure_checkpoint_dir, get_session

# Functions of this package travel to the executors by value, so these need no
# copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "ensure_checkpoint_dir"]
