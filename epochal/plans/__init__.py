"""Queries over the supplied tables, built from the operators."""
