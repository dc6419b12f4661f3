"""Spark-native text analytics: sources, text functions, operators, plans and streaming."""
