"""Operators on tables, each a function of Spark tables."""
