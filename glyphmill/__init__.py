"""Glyphmill: a Spark-native engine for preparing, indexing and measuring text context."""

__version__ = "0.1.0"
