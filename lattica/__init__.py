"""Sparse linear algebra and benchmark-log analytics on Spark DataFrames."""
