"""Calling-context analytics on Spark: contexts, context trees, hot subtrees, sketches, comparison."""
