"""Posterior and simulation-output analytics on Spark DataFrames."""
