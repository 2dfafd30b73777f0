"""Reads, merges, mutations and checks on keyed tables, each from DataFrames to a DataFrame."""
