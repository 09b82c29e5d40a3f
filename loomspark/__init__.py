"""Spark-first analytics operators for catalogue-style data."""
