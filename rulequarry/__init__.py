"""Spark-native discovery, evaluation and audit of logical rules in relational data."""

__version__ = "0.1.0"
