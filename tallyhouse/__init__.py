"""Spark-native analytics toolkit: lazy functions from DataFrames to a DataFrame."""
