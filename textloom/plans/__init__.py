"""Whole analyses put together from the operators, and the queries that run them."""
