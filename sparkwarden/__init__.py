"""Spark-native log analytics: parsing, scoring, similarity, evaluation and streaming operators."""

__version__ = "0.1.0"
