"""Readers and source conversions."""
