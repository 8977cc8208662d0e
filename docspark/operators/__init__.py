"""Predicates, expressions, accumulators, pipeline stages and updates as Columns and DataFrames."""
