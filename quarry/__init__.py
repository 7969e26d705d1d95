"""Quarry: code-health analytics and text-corpus processing on Spark DataFrames."""
