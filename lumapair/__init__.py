"""Paired-image evaluation analytics as Spark DataFrame operations."""
