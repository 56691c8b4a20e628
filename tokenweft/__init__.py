"""Spark-native multi-vector retrieval: scoring, encoding, indexing and search as DataFrame plans."""

__version__ = "0.1.0"
