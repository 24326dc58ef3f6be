"""Operators on grains tables, each a function from DataFrames to a DataFrame."""
