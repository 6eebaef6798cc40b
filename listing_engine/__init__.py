"""Property-listing analytics on Spark: unify, parse, match, explain, explore."""
