"""Sparse-feature analytics on Spark."""
