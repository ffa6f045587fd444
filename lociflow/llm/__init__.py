"""Operators for training data.  Nothing outside this package imports it."""

QUERY_MODULES = ["queries"]
