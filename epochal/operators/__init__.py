"""Operators on histories of transactions; each takes and returns DataFrames."""
