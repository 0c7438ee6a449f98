"""Joins that Spark has no operator for: as-of and band joins."""
