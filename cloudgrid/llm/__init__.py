"""Operators for preparing training text, all built on DataFrames."""
