"""Audit operators: DataFrames in, one DataFrame out."""
