"""Operators that prepare training text: each takes and returns DataFrames."""
