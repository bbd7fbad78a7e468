"""Reading and writing logs: data contracts, checked readers, routed writers,
and the log views that the tests derive from the given tables."""
