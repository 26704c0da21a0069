"""linkweave: graph-evidence entity mapping and corpus processing on Spark."""
