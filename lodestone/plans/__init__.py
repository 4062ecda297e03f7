"""Queries to DataFrames (compiler) and to the text of EXPLAIN (explain)."""
