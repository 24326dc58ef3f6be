"""The query language: tokens, syntax tree, and its binding to DataFrames."""
