"""Paired rating analytics on Spark DataFrames."""
