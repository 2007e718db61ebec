"""Transforms of DataFrames; columns are parameters."""
