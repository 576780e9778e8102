"""Temporal splat analytics as ordinary Spark DataFrames."""
