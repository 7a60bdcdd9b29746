"""Versioned-table analytics on Spark: histories of transactions as DataFrames."""
