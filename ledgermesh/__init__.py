"""Spark-first record linkage and data processing."""
