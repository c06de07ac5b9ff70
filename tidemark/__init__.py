"""Probabilistic time-series forecast evaluation on Spark DataFrames."""
