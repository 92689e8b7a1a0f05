"""tessera — mixed-type clustering on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames; the only values
that reach the driver are small fitted constants (medians, vocabularies,
centroids, a d x d covariance) whose size does not grow with the row count.

Sub-packages
------------
sources    readers, input discovery, sinks, run records
functions  column expressions: numeric coercion, distances, formatting, quantiles
operators  profile, encode, status, sampling, neighbours, cover, summarise,
           reduce (PCA/UMAP), cluster (k-means), density (HDBSCAN), evaluate
plans      fixtures derived from the driver tables, end-to-end jobs, sweeps
streaming  (empty by design: the modelled workload is batch only)
"""

__version__ = "0.1.0"
