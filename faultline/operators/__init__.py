"""Operators from lines to ranked groups; each is a function from DataFrames to DataFrames."""
