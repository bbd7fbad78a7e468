"""Column functions: each takes and returns Spark columns, all JVM-side
except the p-value helper in :mod:`fieldtally.functions.tails`."""
