"""Palaver: discussion mining on Spark DataFrames."""
