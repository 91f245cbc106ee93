"""Batch operators over canonical transaction DataFrames."""
