"""Operators: pure functions from DataFrames (and literals) to DataFrames."""
