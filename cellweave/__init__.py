"""Cellweave: spreadsheet-like files as queryable Spark DataFrames."""
