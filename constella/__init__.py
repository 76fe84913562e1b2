"""constella: a PySpark analytics engine that turns a table or a stream into an
explained point cloud (profile, clean, scale, reduce, cluster, flag anomalies,
assemble and explain), plus the catalogue, point-cloud and streaming queries
around it.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame.
Fitted parameters (means, covariances, centres, trees) are small driver-side
values bounded by the number of features, clusters or trees, never by rows.
"""

from constella.session import get_spark, prepare, shared_dir

__all__ = ["get_spark", "prepare", "shared_dir"]
