"""Corpus chunking and embedding as plain Spark DataFrame operators."""
