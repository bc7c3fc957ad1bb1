"""Joins, matching and aggregates over DataFrames."""
