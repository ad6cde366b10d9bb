"""Corpus preparation and summary scoring as Spark DataFrame operations."""
