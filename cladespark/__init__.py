"""Evolutionary-tree analytics on Spark DataFrames."""
