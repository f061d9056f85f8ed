"""Lookup tables: fixed values, small seed tables, and helpers that turn them into DataFrames."""
