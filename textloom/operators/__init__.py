"""Operators on DataFrames of texts, terms, units, vectors and clusters."""
