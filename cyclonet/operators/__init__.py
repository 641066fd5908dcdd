"""Operators: DataFrames, key columns and parameters in, a DataFrame out."""
