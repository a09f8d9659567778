"""Spark-first text privacy analytics: sources, functions, operators, plans and streams."""
