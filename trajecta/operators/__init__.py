"""Joins, aggregates, windows and grids over DataFrames."""
