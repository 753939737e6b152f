"""Strict delimited-text reading and writing for PySpark."""
