"""Operators: pure functions from DataFrames and a specification to DataFrames."""
