"""Sentence-level text scoring and its evaluation, on Spark DataFrames."""
