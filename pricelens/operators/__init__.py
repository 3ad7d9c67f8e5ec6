"""Relational operators: every function maps DataFrames to a DataFrame."""
