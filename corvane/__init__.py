"""Corpus preparation, retrieval, retrieval evaluation and log analytics as Spark DataFrame operations."""
