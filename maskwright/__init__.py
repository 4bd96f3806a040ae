"""Spark-native corpus sanitization: detect, alias, rewrite, audit and restore sensitive values."""
