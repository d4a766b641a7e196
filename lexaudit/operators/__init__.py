"""Operators on DataFrames: audits, joins, sampling, scoring, learning and metrics."""
